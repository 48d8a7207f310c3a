"""The place of a sign on its page, in eight passes (G24): candidates from an inverted index, neighbours from cells, vetoes.

Phrases are indexed by what a pass looks for: pieces of an identifier, words, room numbers, runs of letters and digits.
Each pass joins signs to the index by equality, within file and page; words that are only alike meet through the similarity
join over the distinct words of both sides. No sign is held against all phrases of its page. Neighbourhoods are
equi-joins on cells as wide as the reach. All of these meet by shuffles, so that nothing passes the driver. Every pass gives at most one row per sign, the first pass with a row wins, and an
ambiguous pair is a row without a place, which ends the search.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawlake.functions import vocab as V
from drawlake.functions.text import squeezed_id, tokens_alnum
from drawlake.operators.similarity import similar_strings
from drawlake.session import scratch

PAGE = ["file_id", "page"]


def canonical_word(word: Column) -> Column:
    """A lower-case word, written out if it is a short form."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in V.SIGN_WORDS.items() for x in pair]), word), word)


def word_score(query: Column, target: Column) -> Column:
    """Mean over the query's words of their best word in the target: equal 1, the same written out .95, a prefix its share, else 1 - edits / longer length."""

    def one(q: Column, t: Column) -> Column:
        short, long = F.least(F.length(q), F.length(t)), F.greatest(F.length(q), F.length(t))
        prefix = F.when(q.startswith(t) | t.startswith(q), short / long).otherwise(0.0)
        alike = F.when(canonical_word(q) == canonical_word(t), F.lit(0.95)).otherwise(1 - F.levenshtein(q, t) / long)
        return F.when(q == t, 1.0).otherwise(F.greatest(prefix, alike))

    best = F.transform(query, lambda q: F.coalesce(F.array_max(F.transform(target, lambda t: one(q, t))), F.lit(0.0)))
    total = F.aggregate(best, F.lit(0.0), lambda a, x: a + x)
    return F.when((F.size(query) == 0) | (F.size(target) == 0), F.lit(0.0)).otherwise(total / F.size(query))


def _runs(squeezed: Column) -> Column:
    return F.array_distinct(F.filter(F.split(squeezed, "[^a-z0-9]+"), lambda t: t != ""))


def _squeezed(c: Column) -> Column:
    return F.lower(squeezed_id(c))


def _blank_words(c: Column) -> Column:
    """Words between blanks, of two characters or more, lowered."""
    return F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda t: F.length(t) >= 2)


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _distance(a: str = "", b: str = "h_") -> Column:
    dx, dy = F.col(f"{a}cx") - F.col(f"{b}cx"), F.col(f"{a}cy") - F.col(f"{b}cy")
    return F.sqrt(dx * dx + dy * dy)


def indexed_phrases(phrases: DataFrame) -> DataFrame:
    """``file_id, page, seq, text, x0, y0, x1, y1`` -> the same with centre, words, squeezed text and its runs; ``drawn`` tells the drawing from its margins."""
    cy = (F.col("y0") + F.col("y1")) / 2
    d = phrases.select(*PAGE, "seq", "text", "x0", "y0", "x1", "y1", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), cy.alias("cy"), _squeezed(F.col("text")).alias("sq"), tokens_alnum(F.col("text")).alias("words"))
    return d.where("text IS NOT NULL").withColumn("runs", _runs(F.col("sq"))).withColumn("drawn", (F.col("cy") >= 0.04) & (F.col("cy") <= 0.96) & (F.length(F.trim("text")) >= 2))


def prepared_signs(signs: DataFrame) -> DataFrame:
    """``file_id, page, sign_id, identifier, location, message`` -> what the passes look for; the range of x that a building's letter leaves."""
    loc, ident = F.coalesce("location", F.lit("")), F.coalesce("identifier", F.lit(""))
    both = F.concat_ws(" ", F.nullif(loc, F.lit("")), F.nullif(F.coalesce("message", F.lit("")), F.lit("")))
    west, east = F.upper(loc).rlike(r"\bA\d{3}[A-Z]?\b"), F.upper(loc).rlike(r"\bB\d{3}[A-Z]?\b")
    kind = F.trim(F.regexp_replace(F.regexp_replace(loc, V.SIGN_ROOM_TOKEN, " "), r"\s+", " "))
    room = F.get(_all(loc, V.SIGN_ROOM_TOKEN), F.lit(0))
    return signs.where("page IS NOT NULL AND file_id IS NOT NULL").select(
        *PAGE, "sign_id", loc.alias("loc"), both.alias("both"), F.upper(F.trim(ident)).alias("verbatim"), _squeezed(ident).alias("id_sq"), F.length(ident).alias("id_length"),
        F.when(east, 0.45).otherwise(0.0).alias("x_low"), F.when(west & ~east, 0.55).otherwise(1.0).alias("x_high"),
        F.when(F.length(kind) >= 2, kind).alias("kind"), F.lower(room).alias("room"),
    )


def _in_range(x: str = "cx") -> Column:
    return (F.col(x) >= F.col("x_low")) & (F.col(x) <= F.col("x_high"))


def _found(rows: DataFrame, number: int, score: Column, x: Column | None = None, y: Column | None = None) -> DataFrame:
    return rows.select("sign_id", F.lit(number).alias("pass"), (F.col("cx") if x is None else x).alias("x"), (F.col("cy") if y is None else y).alias("y"), score.cast("double").alias("score"), F.col("seq"))


def _best(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def _verbatim(s: DataFrame, p: DataFrame) -> DataFrame:
    """The identifier as it stands inside a drawn phrase; both meet under its first characters."""
    index = p.where("drawn").withColumn("up", F.upper(F.trim("text"))).select(*PAGE, "seq", "cx", "cy", "up", F.explode(F.expr("array_distinct(flatten(transform(sequence(2, 3), n -> transform(sequence(1, greatest(length(up) - n + 1, 1)), i -> substring(up, i, n)))))")).alias("gram"))
    q = s.where(F.length("verbatim") >= 2).withColumn("gram", F.substring("verbatim", 1, 3))
    hits = q.join(index.hint("merge"), [*PAGE, "gram"]).where(_in_range() & F.contains("up", "verbatim"))
    return _found(_best(hits, ["sign_id"], F.col("seq")), 1, F.lit(1.0))


def _shared_words(s: DataFrame, p: DataFrame) -> DataFrame:
    """Shared words, written out, over all words of both; words of the location count as often as they stand there."""
    q = s.withColumn("lw", F.transform(_blank_words(F.col("loc")), canonical_word)).where(F.size("lw") > 0)
    index = p.where("drawn").withColumn("pw", F.transform(_blank_words(F.col("text")), canonical_word)).select(*PAGE, "seq", "cx", "cy", "pw", F.explode(F.array_distinct("pw")).alias("word"))
    hits = q.select(*PAGE, "sign_id", "lw", "x_low", "x_high", F.explode(F.array_distinct("lw")).alias("word")).join(index.hint("merge"), [*PAGE, "word"]).where(_in_range()).dropDuplicates(["sign_id", "seq"])
    shared = F.size(F.filter("lw", lambda w: F.array_contains(F.col("pw"), w)))
    hits = hits.withColumn("score", shared / F.size(F.array_union("lw", "pw"))).where("score >= 0.4")
    return _found(_best(hits, ["sign_id"], F.desc("score"), F.col("seq")), 2, F.col("score"))


def _room_numbers(s: DataFrame, p: DataFrame) -> DataFrame:
    index = p.where("drawn").select(*PAGE, "seq", "cx", "cy", F.explode(F.array_distinct(_all(F.upper(F.trim("text")), V.SIGN_ROOM_NUMBER))).alias("number"))
    q = s.select(*PAGE, "sign_id", "x_low", "x_high", F.posexplode(_all(F.upper(F.trim("loc")), V.SIGN_ROOM_NUMBER)).alias("at", "number"))
    hits = q.join(index.hint("merge"), [*PAGE, "number"]).where(_in_range())
    return _found(_best(hits, ["sign_id"], F.col("at"), F.col("seq")), 3, F.lit(0.85))


def _bounded(haystack: str, needle: str) -> Column:
    """The needle stands in the squeezed text with neither a letter nor a digit beside it."""
    return F.expr(f"rlike({haystack}, concat('(?<![a-z0-9])\\\\Q', {needle}, '\\\\E(?![a-z0-9])'))")


def _near(hits: DataFrame, p: DataFrame, reach: float, keep: list[str]) -> DataFrame:
    """Each hit (``h_cx, h_cy``) with the phrases of its page within reach, in the sign's range of x: an equi-join on cells."""
    cell = lambda c: F.floor(F.col(c) / reach).cast("int")
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    a = hits.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around)).withColumn("gx", cell("h_cx") + F.col("_dx")).withColumn("gy", cell("h_cy") + F.col("_dy")).drop("_dx", "_dy")
    b = p.select(*PAGE, "cx", "cy", cell("cx").alias("gx"), cell("cy").alias("gy"), *keep)
    return a.join(b.hint("merge"), [*PAGE, "gx", "gy"]).where(_in_range() & (_distance() <= reach))


def _identifiers(s: DataFrame, p: DataFrame) -> DataFrame:
    """The identifier in full on the whole page: one place, or that whose neighbours within .12 are like the location, by .15 more than the next."""
    q = s.where((F.col("id_length") >= 3) & (F.length("id_sq") >= 3)).withColumn("run", F.get(_runs(F.col("id_sq")), F.lit(0)))
    index = p.select(*PAGE, "seq", "cx", "cy", "sq", F.explode("runs").alias("run"))
    hits = q.join(index.hint("merge"), [*PAGE, "run"]).where(_in_range() & _bounded("sq", "id_sq")).withColumn("n", F.count("*").over(Window.partitionBy("sign_id")))
    one = _found(hits.where("n = 1"), 4, F.lit(1.0))
    many = hits.where("n > 1 AND loc <> ''").select(*PAGE, "sign_id", "seq", "x_low", "x_high", "loc", F.col("cx").alias("h_cx"), F.col("cy").alias("h_cy"))
    said = _near(many, p, 0.12, ["words"]).groupBy("sign_id", "seq", "loc", "h_cx", "h_cy").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("said"))
    order = Window.partitionBy("sign_id").orderBy(F.desc("like"), "seq")
    said = said.withColumn("like", word_score(tokens_alnum(F.col("loc")), F.col("said"))).withColumn("n", F.row_number().over(order)).withColumn("next", F.lead("like").over(order))
    said = said.where("n = 1 AND (next IS NULL OR like - next >= 0.15)").withColumnRenamed("h_cx", "cx").withColumnRenamed("h_cy", "cy")
    return one.unionByName(_found(said, 4, F.lit(0.95)))


def _alike(s: DataFrame, p: DataFrame) -> DataFrame:
    """Signs with the drawn phrases that are like them, and ``like_kind, like_loc, like_both``; a table that three passes read.

    A mean of .6 or more needs one pair of words as similar, or the same written out. Such pairs are found among the distinct
    words, and are what signs and phrases meet by.
    """
    q = s.withColumn("qw", tokens_alnum(F.col("both"))).where(F.size("qw") > 0)
    index = p.where("drawn").select(*PAGE, "seq", "text", "x0", "x1", "cx", "cy", "words", F.explode("words").alias("t"))
    ours = q.select(F.explode("qw").alias("s")).distinct()
    theirs = index.select(F.col("t").alias("s")).distinct()
    same = ours.withColumn("c", canonical_word(F.col("s"))).join(theirs.select(F.col("s").alias("t"), canonical_word(F.col("s")).alias("c")).hint("merge"), "c").select("s", "t")
    pairs = similar_strings(ours, theirs, 0.6).select("s", "t").unionByName(same).distinct()
    hits = q.select(*q.columns, F.explode("qw").alias("s")).join(pairs.hint("merge"), "s").join(index.hint("merge"), [*PAGE, "t"]).where(_in_range()).dropDuplicates(["sign_id", "seq"]).drop("s", "t")
    like = {"like_kind": tokens_alnum(F.coalesce("kind", F.lit(""))), "like_loc": tokens_alnum(F.col("loc")), "like_both": F.col("qw")}
    hits = hits.select(*[c for c in hits.columns if c not in ("qw", "words")], *[word_score(w, F.col("words")).alias(n) for n, w in like.items()])
    hits = hits.where("like_kind >= 0.7 OR like_loc >= 0.65 OR like_both >= 0.6")
    path = scratch(hits.sparkSession, "alike")
    hits.write.parquet(path)
    return hits.sparkSession.read.schema(hits.schema).parquet(path)


def _paired(alike: DataFrame, p: DataFrame) -> DataFrame:
    """A phrase of the kind of room and one with its number within .05; without a place if the next pair is under .02 further."""
    kinds = alike.where("room IS NOT NULL AND like_kind >= 0.7").select(*PAGE, "sign_id", "room", "x_low", "x_high", F.col("seq").alias("kind_seq"), F.col("cx").alias("h_cx"), F.col("cy").alias("h_cy"))
    near = _near(kinds, p.where("drawn"), 0.05, ["seq", "runs"]).where(F.array_contains("runs", F.col("room"))).withColumn("apart", _distance())
    order = Window.partitionBy("sign_id").orderBy("apart", "kind_seq", "seq")
    near = near.withColumn("n", F.row_number().over(order)).withColumn("next", F.lead("apart").over(order)).where("n = 1")
    veto = F.col("next") - F.col("apart") < 0.02
    place = lambda c: F.when(F.coalesce(veto, F.lit(False)), None).otherwise(F.col(c))
    return _found(near, 5, F.lit(0.95), place("cx"), place("cy"))


def _ranked(hits: DataFrame, p: DataFrame, source: str, exclude: Column, keys: list[str]) -> DataFrame:
    """The best of ``hits`` by room numbers within .06 (.6), words of ``source`` within .08 (.3) and score (.1), or words (.65) and score (.35).

    Without a best if the next is under .12 less and the best under .75.
    """
    words = F.array_distinct(F.filter(F.transform(_all(F.col(source), r"\S+"), _squeezed), lambda w: (F.length(w) >= 2) & (w != exclude)))
    rooms = F.transform(_all(F.col(source), V.SIGN_ROOM_TOKEN), F.lower)
    h = hits.withColumn("h_cx", F.col("cx")).withColumn("h_cy", F.col("cy")).withColumn("ask", words).withColumn("rooms", rooms)
    said = lambda w: (F.col("n_sq") == w) | ((F.length(w) >= 3) & F.contains(F.col("n_sq"), w)) | ((F.length("n_sq") >= 3) & F.contains(w, F.col("n_sq")))
    around = _near(h.select(*PAGE, *keys, "seq", "h_cx", "h_cy", "x_low", "x_high", "ask", "rooms"), p.where("drawn").withColumnRenamed("sq", "n_sq").withColumnRenamed("runs", "n_runs"), 0.08, ["n_sq", "n_runs"])
    near_room = (_distance() <= 0.06) & F.arrays_overlap("n_runs", "rooms")
    around = around.select(*keys, "seq", F.filter("ask", said).alias("told"), F.coalesce(near_room, F.lit(False)).alias("at_room"), (_distance() <= 0.05).alias("close"))
    seen = around.groupBy(*keys, "seq").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("told")))).alias("n_told"), F.max("at_room").alias("at_room"), F.max(F.col("close") & (F.size("told") > 0)).alias("context")
    )
    h = h.join(seen.hint("merge"), [*keys, "seq"]).withColumn("told", F.when(F.size("ask") == 0, F.lit(1.0)).otherwise(F.col("n_told") / F.size("ask")))
    total = F.when(F.size("rooms") > 0, F.when(F.col("at_room"), 1.0).otherwise(0.0) * 0.6 + F.col("told") * 0.3 + F.col("score") * 0.1).otherwise(F.col("told") * 0.65 + F.col("score") * 0.35)
    return h.withColumn("total", total).withColumn("context", F.col("context") | (F.size("ask") == 0))


def _decided(ranked: DataFrame, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("total"), "seq")
    d = ranked.withColumn("n", F.row_number().over(order)).withColumn("next", F.lead("total").over(order)).where("n = 1")
    return d.where("next IS NULL OR total - next >= 0.12 OR total >= 0.75")


def _tight(said: Column) -> Column:
    """The middle of the words of the phrase that are the words of ``said`` in their order, at least half of them; else of the phrase."""
    words, ask = F.filter(F.split("text", r"\s+"), lambda w: w != ""), F.filter(F.split(F.upper(F.trim(said)), r"\s+"), lambda w: w != "")
    spans = F.size(words) - F.size(ask)
    starts = F.when((spans >= 0) & (F.size(ask) > 0), F.sequence(F.lit(0), F.greatest(spans, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    hits = F.transform(starts, lambda k: F.aggregate(F.zip_with(F.slice(words, k + 1, F.size(ask)), ask, lambda a, b: F.when(F.upper(a) == b, 1).otherwise(0)), F.lit(0), lambda a, x: a + x))
    most = F.array_max(hits)
    at = F.array_position(hits, most) - 1
    chars = lambda ws: F.aggregate(ws, F.lit(0), lambda a, w: a + F.length(w))
    span, every = F.col("x1") - F.col("x0"), chars(words)
    low = F.col("x0") + chars(F.slice(words, F.lit(1), at.cast("int"))) / every * span
    high = F.col("x0") + chars(F.slice(words, F.lit(1), (at + F.size(ask)).cast("int"))) / every * span
    return F.when((most > 0) & (most / F.size(ask) >= 0.5), (low + high) / 2).otherwise((F.col("x0") + F.col("x1")) / 2)


def _phrases_of_location(alike: DataFrame, p: DataFrame) -> DataFrame:
    hits = alike.where("like_loc >= 0.65").withColumnRenamed("like_loc", "score")
    best = _decided(_ranked(hits, p, "loc", F.lit(""), ["sign_id"]), ["sign_id"])
    return _found(best, 6, F.least(F.lit(1.0), 0.8 + (F.col("score") - 0.65) / (1 - 0.65) * 0.2), _tight(F.col("loc")))


def _room_tokens(s: DataFrame, p: DataFrame) -> DataFrame:
    """Room numbers of location and message, the longest first, also behind one more letter, where words of the sign stand within .05."""
    longest = F.expr("transform(array_sort(transform(array_distinct(tokens), t -> struct(-length(t) AS n, array_position(tokens, t) AS at, t AS t))), x -> x.t)")
    q = s.withColumn("tokens", _all(F.col("both"), V.SIGN_ROOM_TOKEN)).select("*", F.posexplode(longest).alias("at", "token")).drop("tokens").withColumn("run", F.lower("token"))
    keys = F.when(F.col("sq").rlike("^[a-z]"), F.array_union("runs", F.array(F.substring("sq", 2, 1 << 20)))).otherwise(F.col("runs"))
    index = p.where("drawn").select(*PAGE, "seq", "text", "x0", "x1", "cx", "cy", F.explode(keys).alias("run"))
    hits = q.join(index.hint("merge"), [*PAGE, "run"]).where(_in_range()).withColumn("score", F.lit(0.75))
    best = _decided(_ranked(hits, p, "both", F.col("run"), ["sign_id", "at"]).where("context"), ["sign_id", "at"])
    return _found(_best(best, ["sign_id"], F.col("at")), 7, F.lit(0.75), _tight(F.col("token")))


def _like_anything(alike: DataFrame, p: DataFrame) -> DataFrame:
    best = _best(alike.where("like_both >= 0.6").withColumnRenamed("like_both", "score"), ["sign_id"], F.desc("score"), F.col("seq"))
    return _found(best, 8, F.col("score"), _tight(F.col("both")))


def sign_places(signs: DataFrame, phrases: DataFrame) -> DataFrame:
    """``sign_id, pass, x, y, score, seq`` of every sign that has a place; ``seq`` is its phrase.

    signs: ``file_id, page, sign_id, identifier, location, message``, a ``sign_id`` each; phrases: ``file_id, page, seq, text, x0, y0,
    x1, y1`` in parts of the page, read from a table. Nulls in a sign's texts are empty; signs without page or file and phrases without text or place are left out;
    no rows in, no rows out. Passes: 1 the identifier as it stands, 2 shared words (.4), 3 a room number (.85), 4 the identifier in full
    (1 or .95), 5 kind and number side by side (.95, or no place at all if two pairs are nearly as near), 6 phrases like the
    location (.65), ranked by their surroundings, 7 room numbers with context (.75), 8 the phrase most like location and message (.6).
    """
    s, p = prepared_signs(signs), indexed_phrases(phrases)
    alike = _alike(s, p)
    passes = [f(s, p) for f in (_verbatim, _shared_words, _room_numbers, _identifiers, _room_tokens)] + [f(alike, p) for f in (_paired, _phrases_of_location, _like_anything)]
    rows = reduce(DataFrame.unionByName, passes)
    return _best(rows, ["sign_id"], F.col("pass")).where("x IS NOT NULL").select("sign_id", "pass", "x", "y", "score", "seq")
