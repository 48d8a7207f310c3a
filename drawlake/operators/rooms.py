"""Rooms: flags of labels (G21, G22), flags of names (section 2.10), nearest anchors and neighbours (C11, C12), duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawlake.functions import vocab as V
from drawlake.functions.text import bigrams, straight, tokens_spaced
from drawlake.operators.filters import any_substring, any_word
from drawlake.operators.joins import k_nearest, nearest


def label_flags(rooms: DataFrame) -> DataFrame:
    """The flags that a drawing's label gives (``room_name, occupant_load, occupancy_group``); the columns are added."""
    name, load, group = F.upper("room_name"), F.col("occupant_load"), F.col("occupancy_group")
    sub = lambda words: any_substring(name, list(words))
    mep = sub(V.LABEL_MEP) & (load.isNull() | (load == 0))
    flags = {
        "is_restroom": sub(V.LABEL_RESTROOM) | any_word(name, list(V.LABEL_RESTROOM_WORDS)),
        "is_stair": name.startswith("STAIR"),
        "is_elevator": sub(V.LABEL_ELEVATOR),
        "is_vestibule": sub(V.LABEL_VESTIBULE),
        "is_corridor_or_hall": sub(V.LABEL_CORRIDOR),
        "is_vehicle_bay": sub(V.LABEL_VEHICLE),
        "is_mep_unoccupied": mep,
        "is_variable_use": any_word(name, list(V.LABEL_VARIABLE_WORDS)) & ~mep & ~sub(V.LABEL_STORAGE),
        "is_public_facing": sub(V.LABEL_PUBLIC),
        "is_staff_only": sub(V.LABEL_STAFF),
        "is_assembly": F.coalesce(group.rlike(r"^A[-\s]?[0-9]"), F.lit(False)) | F.coalesce(load >= 50, F.lit(False)),
        "is_office": sub(V.OFFICE),
        "is_suite": sub(V.SUITE),
        "is_residential_unit": F.trim("room_name").rlike(V.RESIDENTIAL_UNIT),
    }
    return rooms.withColumns({k: F.coalesce(c, F.lit(False)) for k, c in flags.items()})


def ambiguous() -> Column:
    """A room that a model should look at (G22): uncertain, very short and unknown, or without any flag; residential units never."""
    short = F.upper(F.regexp_replace("room_name", r"\s+", ""))
    flags = ("is_restroom", "is_stair", "is_elevator", "is_vestibule", "is_corridor_or_hall", "is_vehicle_bay", "is_mep_unoccupied", "is_variable_use", "is_public_facing", "is_staff_only", "is_assembly")
    none = F.lit(True)
    for f in flags:
        none = none & ~F.col(f)
    odd = (F.length(short) < 4) & ~short.isin(*V.KNOWN_SHORT)
    return ~F.col("is_residential_unit") & ((F.col("extraction_confidence") < 0.5) | odd | none)


def in_set(tokens: Column, pairs: Column, low: Column, words: tuple[str, ...]) -> Column:
    """A token, or two neighbours, of the name are in the set, or an entry with a blank occurs in it."""
    known = F.array(*[F.lit(w) for w in words])
    out = F.arrays_overlap(tokens, known) | F.arrays_overlap(pairs, known)
    for w in words:
        if " " in w:
            out = out | low.contains(w)
    return F.coalesce(out, F.lit(False))


def name_flags(rooms: DataFrame, prefix: str = "n_") -> DataFrame:
    """The flags that the room's name and level give by themselves (``room_name, level``), added under a prefix."""
    d = rooms.withColumn("_low", F.lower(F.trim("room_name"))).withColumn("_t", tokens_spaced(F.col("_low"))).withColumn("_b", bigrams(F.col("_t")))
    t, b, low = F.col("_t"), F.col("_b"), F.col("_low")
    has = lambda words: in_set(t, b, low, words)
    p = prefix
    d = d.withColumns({f"{p}women": has(V.WOMEN), f"{p}men": has(V.MEN), f"{p}unisex_word": has(V.UNISEX), f"{p}mep_word": has(V.MEP), f"{p}assembly": has(V.ASSEMBLY), f"{p}corridor": has(V.CORRIDOR), f"{p}elevator": has(V.ELEVATOR), f"{p}stair": has(V.STAIR), f"{p}vehicle": has(V.VEHICLE)})
    d = d.withColumn(f"{p}restroom", has(V.RESTROOM) | F.col(f"{p}women") | F.col(f"{p}men") | F.col(f"{p}unisex_word"))
    d = d.withColumn(f"{p}mep", ~F.col(f"{p}restroom") & F.col(f"{p}mep_word")).withColumn(f"{p}staff", F.col(f"{p}restroom") & any_substring(low, list(V.STAFF_RESTROOM)))
    d = d.withColumns(
        {
            f"{p}gendered": (F.col(f"{p}women") | F.col(f"{p}men")) & F.col(f"{p}restroom"),
            f"{p}unisex": F.col(f"{p}unisex_word") & F.col(f"{p}restroom"),
            f"{p}accessible": any_substring(low, list(V.ACCESSIBLE)),
            f"{p}public": has(V.PUBLIC) | (F.col(f"{p}restroom") & ~F.col(f"{p}staff")),
            f"{p}mezzanine": F.lower(F.coalesce("level", F.lit(""))).contains("mezz") | low.contains("mezz"),
            f"{p}variable": has(V.VARIABLE_USE) & ~F.col(f"{p}assembly") & ~F.col(f"{p}mep") & ~has(V.STORAGE),
            f"{p}office": has(V.OFFICE) & ~F.col(f"{p}restroom") & ~F.col(f"{p}stair") & ~F.col(f"{p}elevator") & ~F.col(f"{p}corridor") & ~F.col(f"{p}mep"),
            f"{p}suite": has(V.SUITE) & ~F.col(f"{p}restroom") & ~F.col(f"{p}mep"),
            f"{p}true_mep": F.arrays_overlap(t, F.array(*map(F.lit, V.MEP))),
            f"{p}occupied_word": F.arrays_overlap(t, F.array(*map(F.lit, V.OCCUPIED))),
        }
    )
    return d.drop("_low", "_t", "_b", f"{p}unisex_word", f"{p}mep_word")


def zone_qualifiers(rooms: DataFrame, anchors: DataFrame) -> DataFrame:
    """Each room's nearest anchor of its page, if it is within twice that anchor's longer side (C11); the distance is tested after the choice."""
    a = anchors.select("file_id", "pdf_page", F.col("seq").alias("a_seq"), F.col("text").alias("zone"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.greatest("w", "h").alias("reach"))
    pairs = rooms.join(a, ["file_id", "pdf_page"]).withColumn("dist", straight(F.col("x") - F.col("ax"), F.col("y") - F.col("ay")))
    best = nearest(pairs, ["file_id", "seq"], "dist", "a_seq", ["zone", "reach"]).where("dist <= 2 * reach")
    return rooms.join(best.select("file_id", "seq", F.col("zone").alias("zone_qualifier")), ["file_id", "seq"], "left")


def staff_only_by_neighbours(rooms: DataFrame, k: int = 5) -> DataFrame:
    """Restrooms whose k nearest other rooms of the page are all back of house, and none public or assembly, are staff only."""
    around = rooms.where("NOT is_restroom AND x IS NOT NULL").select("file_id", "pdf_page", F.col("seq").alias("o_seq"), F.col("x").alias("ox"), F.col("y").alias("oy"), *[F.col(c).alias("o_" + c) for c in ("is_office", "is_mep_unoccupied", "is_staff_only", "is_public_facing", "is_assembly")])
    pairs = rooms.where("is_restroom AND x IS NOT NULL").select("file_id", "pdf_page", "seq", "x", "y").join(around, ["file_id", "pdf_page"])
    near = k_nearest(pairs.withColumn("dist", straight(F.col("x") - F.col("ox"), F.col("y") - F.col("oy"))), ["file_id", "seq"], "dist", "o_seq", k)
    house = F.col("o_is_office") | F.col("o_is_mep_unoccupied") | F.col("o_is_staff_only")
    staff = near.groupBy("file_id", "seq").agg((F.bool_and(house) & ~F.bool_or(F.col("o_is_public_facing") | F.col("o_is_assembly"))).alias("_staff"))
    d = rooms.join(staff, ["file_id", "seq"], "left").withColumn("_staff", F.coalesce("_staff", F.lit(False)))
    return d.withColumns({"is_staff_only": F.col("is_staff_only") | F.col("_staff"), "is_public_facing": F.col("is_public_facing") & ~F.col("_staff")}).drop("_staff")


def with_loads(rooms: DataFrame, loads: DataFrame) -> DataFrame:
    """Occupant loads by room number in upper case; of several the last."""
    last = loads.groupBy(F.upper("room_number").alias("_n")).agg(F.max_by("occupant_load", "seq").alias("_load"))
    return rooms.withColumn("_n", F.upper("room_number")).join(last, "_n", "left").withColumn("occupant_load", F.coalesce("_load", "occupant_load")).drop("_n", "_load")


def deduplicated(rooms: DataFrame, radius: float = 0.025) -> DataFrame:
    """Labels of a page within a radius of one that is kept already give way, the more confident of the two staying.

    What is kept depends on what was kept before: each page is folded in order of seq.
    """
    schema = rooms.schema

    def fold(page):
        kept: list = []
        for row in page.sort_values("seq").itertuples(index=False):
            for i, k in enumerate(kept):
                if (k.x - row.x) ** 2 + (k.y - row.y) ** 2 < radius**2:
                    if row.extraction_confidence > k.extraction_confidence:
                        kept[i] = row
                    break
            else:
                kept.append(row)
        return type(page)(kept, columns=page.columns)

    return rooms.groupBy("file_id", "pdf_page").applyInPandas(fold, schema)


def duplicate_rooms(rooms: DataFrame) -> DataFrame:
    """Rooms without a number that share file, level and name, with the size of their group."""
    w = Window.partitionBy("file_id", "level", "room_name")
    return rooms.where("room_number IS NULL").withColumn("group_size", F.count("*").over(w).cast("long"))
