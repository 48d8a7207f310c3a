"""Signs to places on a page (G24, I10, I12, T1-T5, T27): passes as candidate rows with a rank, the best row of each sign wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawlake.functions import vocab as V
from drawlake.functions.text import jaccard, phrase_score, squeezed_id, tokens_alnum
from drawlake.operators.joins import dealt_join
from drawlake.operators.windows import first_of

#: Room tokens: a letter or two and digits, or digits and a letter or two.
ROOM_TOKEN = r"\b(?:[A-Za-z]{1,2}\d{2,4}[A-Za-z]?|\d{2,4}[A-Za-z]{0,2})\b"


def location_parts(location: Column) -> Column:
    """(room, kind): the first room token of a location and what is left of it."""
    room = F.nullif(F.regexp_extract(location, ROOM_TOKEN, 0), F.lit(""))
    kind = F.trim(F.regexp_replace(F.regexp_replace(location, ROOM_TOKEN, " "), r"\s+", " "))
    return F.struct(room.alias("room"), kind.alias("kind"))


def near_room(phrase: Column, token: Column) -> Column:
    """A phrase is the token, or the token after one more letter (T27); both squeezed and lowered."""
    return (phrase == token) | ((F.length(phrase) == F.length(token) + 1) & phrase.rlike("^[a-z]") & (F.substring(phrase, 2, 1000) == token))


def matched(signs: DataFrame, phrases: DataFrame) -> DataFrame:
    """``sign_id, pass, score, x, y`` of each sign's best place.

    signs: ``file_id, page, sign_id, identifier, sign_type, location``. Passes in order: the identifier as it stands,
    words of the location (Jaccard .4 or more), the room's number (.85), the best phrase (.65 or more), room tokens
    with a letter before (.75), and the best phrase again at .6. Ties go to the first phrase. Pairs are those of a page.
    """
    s = signs.withColumn("_id", F.lower(squeezed_id(F.coalesce("identifier", F.lit(""))))).withColumn("_loc", location_parts(F.coalesce("location", F.lit(""))))
    s = s.withColumn("_room", F.lower(squeezed_id(F.coalesce("_loc.room", F.lit(""))))).withColumn("_w", tokens_alnum(F.coalesce("location", F.lit(""))))
    p = phrases.select("file_id", "page", "seq", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"), F.lower(squeezed_id(F.col("text"))).alias("_p"), tokens_alnum(F.col("text")).alias("_t"))
    d = dealt_join(s, p, ["file_id", "page"]).withColumn("_j", jaccard(F.col("_w"), F.col("_t")))
    of = lambda n, score: F.struct(F.lit(n).alias("pass"), score.alias("score"))
    plain = (
        F.when((F.length("_id") >= 2) & (F.col("_p") == F.col("_id")), of(1, F.lit(1.0)))
        .when((F.size("_w") > 0) & (F.col("_j") >= 0.4), of(2, F.col("_j")))
        .when((F.col("_room") != "") & (F.col("_p") == F.col("_room")), of(3, F.lit(0.85)))
    )
    near = (F.col("_room") != "") & near_room(F.col("_p"), F.col("_room"))
    # An array of one, so that the phrase is scored once, and only where the plain passes found nothing.
    scored = F.transform(F.array(phrase_score(F.col("_w"), F.col("_t"))), lambda s: F.when(s >= 0.65, of(4, s)).when(near, of(5, F.lit(0.75))).when(s >= 0.6, of(6, s)))[0]
    hit = F.coalesce(plain, scored)
    d = d.withColumn("_h", hit).where(F.col("_h").isNotNull())
    best = F.min_by(F.struct("_h.pass", "_h.score", "x", "y"), F.struct(F.col("_h.pass"), (-F.col("_h.score")).alias("m"), "seq"))
    return d.groupBy("sign_id").agg(best.alias("b")).select("sign_id", "b.*")


def placed(signs: DataFrame, places: DataFrame) -> DataFrame:
    """Markers: stored places score 1, matched ones stand a little lower, the rest are ghosts in the middle."""
    m = places.select("sign_id", F.col("x").alias("mx"), F.col("y").alias("my"), F.col("score").alias("ms"))
    d = signs.join(m, "sign_id", "left")
    stored = F.col("x_pos").isNotNull() & F.col("y_pos").isNotNull()
    edge = lambda c: F.greatest(F.lit(0.02), F.least(F.lit(0.98), c))
    of = lambda x, y, s: F.struct(x.alias("x"), y.alias("y"), s.alias("score"))
    place = F.when(stored, of(F.col("x_pos"), F.col("y_pos"), F.lit(1.0))).when(F.col("ms").isNotNull(), of(edge(F.col("mx")), edge(F.col("my") + 0.03), F.col("ms"))).otherwise(of(F.lit(0.5), F.lit(0.5), F.lit(0.0)))
    return d.withColumn("place", place).select(*signs.columns, "place.*")


def written_back(markers: DataFrame) -> DataFrame:
    """Places worth storing: matched well, where nothing is stored (T4)."""
    return markers.where("x_pos IS NULL AND y_pos IS NULL AND score >= 0.5").select("sign_id", "x", "y")


def signs_of_page(signs: DataFrame, page: int, schedule_pages: list[int]) -> DataFrame:
    """A page's signs: on it (no page means the first), or unplaced and from a schedule's page."""
    on = F.coalesce("page_number", F.lit(1)) == page
    return signs.where(on | (F.col("x_pos").isNull() & F.col("page_number").isin(schedule_pages)))


def auto_located(clusters: DataFrame, signs: DataFrame, most: int = 20, keep: int = 3) -> DataFrame:
    """Each job's first twenty unplaced signs that are not in residential units, and their unambiguous clusters, from top to bottom: one is applied, several are kept as candidates, none fails (T5)."""
    unit = F.coalesce(F.trim("location").rlike(V.RESIDENTIAL_UNIT), F.lit(False))
    todo = first_of(signs.where(F.col("x_pos").isNull() & ~unit), ["job_id"], ["sign_id"], most)
    c = clusters.where("NOT ambiguous").groupBy("sign_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("y", "x"))), 1, keep).alias("candidates"))
    d = todo.join(c, "sign_id", "left")
    return d.withColumn("outcome", F.when(F.col("candidates").isNull(), "failed").when(F.size("candidates") == 1, "applied").otherwise("candidates"))
