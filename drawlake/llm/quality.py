"""Quality rules: learned decision lists, in DataFrame operations only.

Sequential covering: a rule is a conjunction of thresholds on statistics of the text. It grows by the condition of
the greatest information gain on two thirds of the labelled sample, is cut back to its best prefix on the rest, and
stands only if it is precise there; what it covers goes, and the next rule grows. The counts behind each choice are
one small grouped sum. The list becomes one ordered conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drawlake.llm.common import SPACE, WORD, documents, materialize, table, whole

#: Labelled documents that rules are learned from, at most: those with the smallest hash of their id.
SAMPLE_ROWS = 8000
#: Thresholds per statistic, conditions per rule, rules, and what a rule must reach on the held-out third.
BINS, CONDITIONS, RULES, PRECISION, SUPPORT = 24, 3, 12, 0.97, 4
STATISTICS = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "exclaim_share", "upper_share", "digit_share", "distinct_share")


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` packed as ``row``, and the counts of each whole text.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words as the rules below mean them, and n_exclaim, n_upper,
    n_digits, n_distinct. All are 0 for null and empty texts.
    """
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), whole(F.col(text)).alias("t"))
    d = d.withColumn("w", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)))
    d = d.withColumn("lines", F.filter(F.split("t", "\n", -1), lambda x: x.rlike(f"[^{SPACE}]")))
    # A hash for each window of five words; only texts in which one returns need more than the count of distinct ones.
    d = d.withColumn("h", F.when(F.size("w") >= 5, F.expr("transform(sequence(1, size(w) - 4), i -> xxhash64(slice(w, i, 5)))")))
    again = F.size(F.array_distinct("h")) < F.size("h")
    d = d.withColumn("hs", F.when(again, F.expr("sort_array(transform(h, (x, i) -> named_struct('x', x, 'i', i)))")))
    twice = "filter(hs, (s, k) -> (k > 0 AND hs[k - 1].x = s.x) OR (k < size(hs) - 1 AND hs[k + 1].x = s.x))"
    d = d.withColumn("at", F.expr(f"sort_array(transform({twice}, s -> s.i))"))
    # A window covers its five words, less those that the next one covers.
    covered = F.expr("aggregate(zip_with(at, slice(at, 2, size(at)), (a, b) -> coalesce(least(b - a, 5), 5)), 0, (s, x) -> s + x)")
    count = lambda rx: F.regexp_count("t", F.lit(rx)).cast("long")
    return d.select(
        "row",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        count("[#*$%&|<>]").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("hs").isNotNull(), covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        count("!").alias("n_exclaim"),
        count(r"\p{Lu}").alias("n_upper"),
        count("[0-9]").alias("n_digits"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
    )


def statistics() -> dict[str, Column]:
    """The statistics that rules may use, over the columns of ``with_counts``; shares of nothing are 0."""
    by = lambda n, of: F.when(F.col(of) > 0, F.col(n) / F.col(of)).otherwise(F.lit(0.0))
    cols = [F.col("n_words").cast("double"), by("word_chars", "n_words"), by("n_symbols", "n_words"), by("n_dup_lines", "n_words"), by("n_repeat_words", "n_words"), by("n_exclaim", "n_words"), by("n_upper", "word_chars"), by("n_digits", "word_chars"), by("n_distinct", "n_words")]
    return dict(zip(STATISTICS, cols, strict=True))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def column(self, over: dict[str, Column]) -> Column:
        return over[self.statistic] > self.threshold if self.above else over[self.statistic] <= self.threshold


@dataclass(frozen=True)
class Binned:
    """A statistic as the number of its thresholds that it is above: it compares with each of them as the statistic does."""

    bin: Column
    cuts: list[float]

    def __gt__(self, threshold: float) -> Column:
        return self.bin > self.cuts.index(threshold)

    def __le__(self, threshold: float) -> Column:
        return self.bin <= self.cuts.index(threshold)


def _all(conditions: list[Condition], over: dict[str, Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.column(over)
    return out


def sample(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", rows: int = SAMPLE_ROWS) -> DataFrame:
    """Statistics and label (``bad``: quality 0) of a bounded sample of the labelled documents; a third is held out.

    Labels without an id or a quality are left out; of several labels for an id the lowest counts.
    """
    chosen = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(rows)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")  # SAMPLE_ROWS rows at most
    counted = with_counts(own)
    return materialize(
        counted.select((F.col("row.quality") == 0).alias("bad"), (F.pmod(F.col("row.order"), F.lit(3)) == 0).alias("held"), base_failed().alias("base_failed"), *[c.alias(n) for n, c in statistics().items()]),
        "quality-sample",
    )


def learn(labelled: DataFrame) -> list[list[Condition]]:
    """Rules in order, each a conjunction that marks a document as bad; none without examples of both kinds."""
    # Thresholds lie half way between neighbours among the quantiles of both kinds, so that they keep clear of either.
    grid = labelled.groupBy("bad").agg(*[F.percentile_approx(n, [k / BINS for k in range(BINS + 1)], 10_000).alias(n) for n in STATISTICS]).collect()
    cuts = {}
    for n in STATISTICS:
        values = sorted({v for row in grid for v in row[n] or []})
        cuts[n] = [(a + b) / 2 for a, b in zip(values, values[1:])]
    # Each value as the number of thresholds under it, once: all that follows counts small whole numbers.
    number = {n: sum((F.when(F.col(n) > t, 1).otherwise(0) for t in cuts[n]), F.lit(0)) for n in STATISTICS if cuts[n]}
    binned = materialize(labelled.select("bad", "held", "base_failed", *[b.cast("int").alias(n) for n, b in number.items()]), "quality-bins")
    over = {n: Binned(F.col(n), cuts[n]) for n in number}
    bins = F.array(*[F.struct(F.lit(n).alias("s"), F.col(n).alias("b")) for n in number])
    left = ~F.col("base_failed")  # those are rejected before any rule is asked
    rules: list[list[Condition]] = []
    count = lambda c: F.count_if(c).cast("long")
    while len(rules) < RULES and any(cuts.values()):
        rule: list[Condition] = []
        for _ in range(CONDITIONS):
            rows = binned.where(left & ~F.col("held") & _all(rule, over)).select("bad", F.explode(bins).alias("x")).groupBy("x.s", "x.b").agg(count(F.col("bad")).alias("p"), count(~F.col("bad")).alias("n")).collect()
            best = _best_condition(rows, cuts)
            if best is None:
                break
            rule.append(best)
        if not rule:
            break
        tried = [_all(rule[: k + 1], over) for k in range(len(rule))]
        row = binned.where(left & F.col("held")).agg(*[count(t & F.col("bad")).alias(f"p{k}") for k, t in enumerate(tried)], *[count(t & ~F.col("bad")).alias(f"n{k}") for k, t in enumerate(tried)]).first()
        score = [((row[f"p{k}"] - row[f"n{k}"]) / max(1, row[f"p{k}"] + row[f"n{k}"]), row[f"p{k}"], -k) for k in range(len(rule))]
        k = max(range(len(rule)), key=lambda k: score[k])
        p, n = row[f"p{k}"], row[f"n{k}"]
        if p < SUPPORT or p < PRECISION * (p + n):
            break
        rules.append(rule[: k + 1])
        left = left & ~_all(rules[-1], over)
    return rules


def _best_condition(rows, cuts: dict[str, list[float]]) -> Condition | None:
    """The threshold with the greatest gain in information about bad documents, from counts per statistic and bin.

    Of equal ones the one farthest from its neighbours counts.
    """
    bins: dict[str, dict[int, tuple[int, int]]] = {}
    for r in rows:
        bins.setdefault(r["s"], {})[r["b"]] = (r["p"], r["n"])
    if not bins:
        return None
    p0, n0 = (sum(v[i] for v in next(iter(bins.values())).values()) for i in (0, 1))
    if p0 == 0 or n0 == 0:
        return None
    best = None
    for s in STATISTICS:
        own = cuts.get(s, ())
        for k, t in enumerate(own):
            room = min([abs(t - o) for o in own[max(0, k - 1) : k] + own[k + 1 : k + 2]], default=0.0) / (abs(own[-1]) or 1.0)
            low = [sum(v[i] for b, v in bins[s].items() if b <= k) for i in (0, 1)]
            for above, (p, n) in ((False, low), (True, (p0 - low[0], n0 - low[1]))):
                if p and p + n < p0 + n0:
                    gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                    if gain > 1e-9 and (best is None or (round(gain, 9), room) > best[:2]):
                        best = round(gain, 9), room, Condition(s, above, t)
    return best and best[2]


def verdict(rules: list[list[Condition]]) -> Column:
    """One ordered conditional over the counts: the first rule that holds rejects; a document that none covers is kept."""
    over = statistics()
    out = F.when(base_failed(), F.lit(False))
    for rule in rules:
        out = out.when(_all(rule, over), F.lit(False))
    return out.otherwise(F.lit(True))


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", rows: int = SAMPLE_ROWS) -> DataFrame:
    """``row`` (the document's columns), the counts, base_failed and kept.

    Null, empty and blank texts have no words and fail the base test; long texts are counted whole; repeated rows are
    judged each. Labels of documents that are not there teach nothing, and without labels of both kinds only the base
    test rejects. An empty table gives an empty result.
    """
    rules = learn(sample(docs, labels, text, doc_id, rows))
    return with_counts(docs, text).withColumn("base_failed", base_failed()).withColumn("kept", verdict(rules))


def kept_documents(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """The documents that the list keeps, their columns as they are.

    The choice is made by a generator: a filter would be pushed below the counts and spell each of them out again.
    """
    chosen = judge(docs, labels, **params).select(F.explode_outer(F.when(F.col("kept"), F.array("row"))).alias("row"))
    return chosen.where(F.col("row").isNotNull()).select("row.*")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
