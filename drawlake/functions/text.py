"""String functions with the semantics that keys and scores rely on (I1-I28, section 1.4)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[\s ﻿]"


def trimmed(c: Column) -> Column:
    """Without white space of any kind at both ends, the no-break space included."""
    return F.regexp_replace(c, f"^{_SPACE}+|{_SPACE}+$", "")


def leading_int(c: Column) -> Column:
    """The whole number a text begins with, null if it begins with none."""
    return F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast("int")


def half_up(c: Column) -> Column:
    """Rounding whose halves go up for negative numbers as well."""
    return F.floor(c + 0.5)


def occurrence_key(*parts: Column) -> Column:
    """Lowered and trimmed parts, null as empty, between double bars."""
    return F.concat_ws("||", *[F.lower(trimmed(F.coalesce(p, F.lit("")))) for p in parts])


def _present(c: Column) -> Column:
    return F.filter(c, lambda t: F.length(t) > 0)


def tokens_spaced(c: Column) -> Column:
    """Lowered, without apostrophes, cut at blanks, slashes, hyphens and underscores."""
    return _present(F.split(F.regexp_replace(F.lower(c), "'", ""), r"[\s/\-_]+"))


def tokens_alnum(c: Column, least: int = 2) -> Column:
    """Distinct runs of a-z and 0-9 of ``least`` characters or more, lowered (I3); ``least`` 4: the significant words (I4)."""
    return F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: F.length(t) >= least))


def bigrams(tokens: Column) -> Column:
    """Neighbouring tokens with a blank between."""
    n = F.size(tokens)
    return F.when(n >= 2, F.zip_with(F.slice(tokens, 1, n - 1), F.slice(tokens, 2, n - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))


def hits_set(text: Column, entries: list[str]) -> Column:
    """A token or two neighbouring ones are in the set, or an entry of several words occurs as it is."""
    tokens = tokens_spaced(text)
    known = F.array(*[F.lit(e.lower()) for e in entries])
    phrases = [F.lower(text).contains(e.lower()) for e in entries if " " in e]
    out = F.arrays_overlap(tokens, known) | F.arrays_overlap(bigrams(tokens), known)
    for p in phrases:
        out = out | p
    return F.coalesce(out, F.lit(False))


def squeezed_id(c: Column, also: str = "") -> Column:
    """Without blanks, hyphens and underscores (I5); upper case and without dots for sheet numbers (I6) with ``also='.'``."""
    out = F.regexp_replace(c, rf"[\s\-_{also}]", "")
    return F.upper(out) if also else out


def bounded(text: Column, needle: str) -> Column:
    """The needle occurs with neither a-z nor 0-9 beside it."""
    return F.lower(text).rlike("(?<![a-z0-9])\\Q" + needle.lower() + "\\E(?![a-z0-9])")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 0 if either is empty (I8)."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def phrase_score(query: Column, target: Column) -> Column:
    """Mean over the query's tokens of their best token in the target: equal 1, prefix its share of length, else similarity."""

    def best(q: Column) -> Column:
        def one(t: Column) -> Column:
            short, long = F.least(F.length(q), F.length(t)), F.greatest(F.length(q), F.length(t))
            return F.when(q == t, 1.0).when(q.startswith(t) | t.startswith(q), short / long).otherwise(similarity(q, t))

        return F.coalesce(F.array_max(F.transform(target, one)), F.lit(0.0))

    total = F.aggregate(F.transform(query, best), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(query) == 0, F.lit(0.0)).otherwise(total / F.size(query))


def word_overlap(a: Column, b: Column) -> Column:
    """Shared words over the greater number of words, 0 if either has none."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / most)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct members (H3); 0 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def first_capture(text: Column, patterns: list[str]) -> Column:
    """First group of the first pattern that matches and captures something."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def first_listed(text: Column, names: list[str], otherwise: str | None = None) -> Column:
    """The first of the names that occurs in the text, in any case."""
    low = F.lower(text)
    out = F.when(low.contains(names[0].lower()), names[0])
    for n in names[1:]:
        out = out.when(low.contains(n.lower()), n)
    return out.otherwise(F.lit(otherwise)) if otherwise is not None else out


def slug(c: Column, length: int = 40) -> Column:
    """Upper case, blanks as underscores, cut."""
    return F.substring(F.regexp_replace(F.upper(trimmed(c)), r"\s+", "_"), 1, length)


def initials(first: Column, last: Column) -> Column:
    """First letters of both names, upper case."""
    return F.upper(F.concat(F.substring(F.coalesce(first, F.lit("")), 1, 1), F.substring(F.coalesce(last, F.lit("")), 1, 1)))


def cut(c: Column, n: int, marker: str = "…") -> Column:
    """At most n characters, with a marker where something is missing."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(marker))).otherwise(c)


def chunk_id(path: Column) -> Column:
    """A path with everything but a-z, A-Z and 0-9 as underscores."""
    return F.regexp_replace(path, "[^a-zA-Z0-9]", "_")


def estimated_tokens(c: Column) -> Column:
    """ceil(characters / 4)."""
    return F.ceil(F.length(c) / 4)


def confidence(*fields: Column) -> Column:
    """Share of the fields that are present, to one decimal."""
    present = sum((F.when(f.isNotNull() & (F.length(f.cast("string")) > 0), 1).otherwise(0) for f in fields), F.lit(0))
    return half_up(present / len(fields) * 10) / 10


def fraction(c: Column) -> Column:
    """Over 1 and up to 100: a percentage; else clamped to 0..1."""
    return F.when((c > 1) & (c <= 100), c / 100).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def proximity(distance: Column) -> Column:
    """1 under .1, .5 under .25, else 0."""
    return F.when(distance < 0.1, 1.0).when(distance < 0.25, 0.5).otherwise(0.0)


def cost(tokens_in: Column, tokens_out: Column, rate_in: float = 0.15, rate_out: float = 0.60) -> Column:
    """Price of tokens by rates per million."""
    return F.coalesce(tokens_in, F.lit(0)) * (rate_in / 1e6) + F.coalesce(tokens_out, F.lit(0)) * (rate_out / 1e6)


def labels(flags: dict[str, Column]) -> Column:
    """Names of the flags that are set, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()]))


def joined_notes(*notes: Column) -> Column:
    """Notes that are there, with "; " between."""
    return F.concat_ws("; ", *notes)


def straight(dx: Column, dy: Column) -> Column:
    """A distance as the root of the sum of squares, as SQL has it: hypot rounds otherwise and so orders near equals otherwise."""
    return F.sqrt(dx * dx + dy * dy)
