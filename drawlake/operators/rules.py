"""The rule engine: which signs each room gets (section 2.10), as columns over two windows and one lookup.

A guard decides first whether a room gets signs at all; each quantity is then one expression, and the list of applied
rules, notes and reasons are arrays of what held. ``corridor_veto_lobby=False`` lifts the guard for lobbies and foyers,
which drawings label as corridors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawlake.functions import vocab as V
from drawlake.functions.text import joined_notes, slug
from drawlake.operators.rooms import name_flags

QUANTITIES = ("room_id", "room_id_insert", "suite_id", "restroom", "exit", "max_occupancy", "stair_corridor", "stair_landing", "in_case_of_fire", "evacuation_map", "office_directory")
#: Sign types and the rule that each row cites.
SIGNS = (
    ("room_id", "ROOM ID SIGN", "R1"),
    ("room_id_insert", "ROOM ID SIGN W/ INSERT", "R2"),
    ("suite_id", "SUITE ID SIGN", "R6"),
    ("restroom", "RESTROOM SIGN", "R7/R8"),
    ("exit", "EXIT SIGN", "R9"),
    ("max_occupancy", "MAX OCCUPANCY SIGN", "R10"),
    ("stair_corridor", "STAIR CORRIDOR SIGN", "R11"),
    ("stair_landing", "STAIR LANDING SIGN", "R11"),
    ("in_case_of_fire", "IN CASE OF FIRE SIGN", "R12"),
    ("evacuation_map", "EVACUATION MAP", "R13"),
    ("office_directory", "OFFICE DIRECTORY", "R14"),
)


def _or(a: str, b: str) -> Column:
    return F.col(a) | F.coalesce(F.col(b), F.lit(False))


def bridged(rooms: DataFrame, corridor_veto_lobby: bool = True) -> DataFrame:
    """Flags of name and label together, and the level rule for staff restrooms (3b), as ``f_*`` columns."""
    d = name_flags(rooms)
    label = F.coalesce("is_corridor_or_hall", F.lit(False))
    if not corridor_veto_lobby:
        label = label & ~F.upper("room_name").rlike("LOBBY|FOYER")
    d = d.withColumns(
        {
            "f_mep": _or("n_mep", "is_mep_unoccupied"),
            "f_bay": _or("n_vehicle", "is_vehicle_bay"),
            "f_corridor": F.col("n_corridor") | label,
            "f_variable": _or("n_variable", "is_variable_use"),
            "f_restroom": _or("n_restroom", "is_restroom"),
            "f_staff": _or("n_staff", "is_staff_only"),
            "f_elevator": _or("n_elevator", "is_elevator"),
            "f_stair": _or("n_stair", "is_stair"),
            "f_assembly": _or("n_assembly", "is_assembly"),
            "f_office": _or("n_office", "is_office"),
            "f_suite": _or("n_suite", "is_suite"),
            "f_public": _or("n_public", "is_public_facing"),
        }
    )
    level = Window.partitionBy("file_id", "level")
    other = ~F.col("f_restroom")
    house = F.col("f_office") | F.col("f_mep") | F.col("f_bay") | F.col("f_corridor") | F.col("f_stair") | F.col("f_elevator")
    only = F.bool_and(F.when(other, house)).over(level) & ~F.bool_or(F.when(other, F.col("f_public") | F.col("f_assembly"))).over(level)
    staff = F.col("f_restroom") & ~F.col("f_staff") & F.coalesce(only, F.lit(False))
    d = d.withColumn("_staff", staff)
    return d.withColumns({"f_staff": F.col("f_staff") | F.col("_staff"), "f_public": F.col("f_public") & ~F.col("_staff")}).drop("_staff")


def with_plaques(rooms: DataFrame, plaques: DataFrame | None) -> DataFrame:
    """The plaque of each restroom: by number, then women's, men's, unisex; the first of the table (C16). Adds has_plaque, plaque_quantity."""
    if plaques is None:
        return rooms.withColumn("has_plaque", F.lit(False)).withColumn("plaque_quantity", F.lit(None).cast("int"))
    p = plaques.select("file_id", F.col("seq").alias("p_seq"), F.upper("room_number").alias("p_number"), F.lower("room_name").alias("p_name"), F.upper("sign_type_code").alias("p_code"), F.col("quantity").alias("p_quantity"))
    first = F.split(F.lower("room_name"), r"\s+")[0]
    says = lambda code, name: F.col("p_code").contains(code) | F.coalesce(F.col("p_name").contains(name), F.lit(False))
    rank = (
        F.when(F.coalesce((F.col("p_number") == F.upper("room_number")) & (F.col("p_number") != ""), F.lit(False)), 1)
        .when(F.col("n_gendered") & first.isin(*V.WOMEN) & (says("WRR", "women") | F.col("p_code").contains("WOMEN")), 2)
        .when(F.col("n_gendered") & first.isin(*V.MEN) & (says("MRR", "men") | F.col("p_code").contains("MEN")), 3)
        .when((F.col("n_unisex") | F.col("n_accessible")) & says("UNR", "unisex"), 4)
    )
    hit = rooms.where("f_restroom").join(p, "file_id").withColumn("rank", rank).where("rank IS NOT NULL")
    best = hit.groupBy("file_id", "seq").agg(F.min_by(F.struct("p_quantity", F.lit(True).alias("found")), F.struct("rank", "p_seq")).alias("p"))
    d = rooms.join(best, ["file_id", "seq"], "left")
    return d.withColumns({"has_plaque": F.col("p").isNotNull(), "plaque_quantity": F.col("p.p_quantity")}).drop("p")


def assign(rooms: DataFrame, plaques: DataFrame | None = None, corridor_veto_lobby: bool = True) -> DataFrame:
    """Rooms (FIXTURES FX4) -> one row each with the eleven quantities, ``applied_rules, exclusion_reasons, ambiguous, ambiguity_note, reason``.

    reason is null for rooms that get a sign. The order of rooms (``seq`` within a file) decides which elevator gets
    the in-case-of-fire sign.
    """
    d = with_plaques(bridged(rooms, corridor_veto_lobby), plaques)
    name, door, load = F.upper("room_name"), F.col("door_count"), F.col("occupant_load")
    has = lambda *words: name.rlike("|".join(words))
    mezz = F.col("n_mezzanine") & F.col("f_mep")
    veto = mezz & F.col("n_true_mep") & ~F.col("n_occupied_word")
    d = d.withColumn("_near", mezz & ~veto)
    stop = F.when(veto, "R15").when(F.col("f_corridor"), "R4").when(F.col("f_mep") & ~F.col("_near"), "MEP").when(F.col("f_bay"), "BAY")
    d = d.withColumn("_stop", stop).withColumn("_on", F.col("_stop").isNull())
    on = F.col("_on")
    plain = ~F.col("f_restroom") & ~F.col("f_stair") & ~F.col("f_elevator")
    by_name = on & ~F.col("f_variable") & plain
    many = by_name & (F.col("f_assembly") | F.col("f_office"))
    lobby = F.col("f_public") & has("LOBBY", "VESTIBULE", "FOYER")
    outlet = has("VESTIBULE", "EXIT", "DISCHARGE")
    exits = F.when(outlet | lobby, 1).when(F.col("f_assembly"), F.when(load >= 1000, 4).when(load >= 500, 3).otherwise(2))
    maps = F.col("f_elevator") | (F.col("f_public") & has("LOBBY", "VESTIBULE", "FOYER", "NARTHEX"))
    quantity = {
        "room_id": F.when(F.col("_stop") == "R4", 0).when(on & F.col("f_variable"), 0).when(many, F.coalesce(door, F.lit(1))).when(by_name, 1),
        "room_id_insert": F.when(on & F.col("f_variable"), F.coalesce(door, F.lit(1))),
        "suite_id": F.when(on & F.col("f_suite"), 1),
        "restroom": F.when(on & F.col("f_restroom"), F.coalesce("plaque_quantity", F.lit(1))),
        "exit": F.when(on, exits),
        "max_occupancy": F.when(on & F.col("f_assembly"), 1),
        "stair_corridor": F.when(on & F.col("f_stair"), F.coalesce(door, F.lit(1))),
        "stair_landing": F.when(on & F.col("f_stair"), 1),
        "in_case_of_fire": F.when(on & F.col("f_elevator"), 1),
        "evacuation_map": F.when(on & maps, 1),
        "office_directory": F.when(on & has("LOBBY", "MAIN ENTRY", "ATRIUM"), 1),
    }
    d = d.withColumns({k: c.cast("int") for k, c in quantity.items()})
    # One in-case-of-fire sign a file: that of its first elevator.
    order = Window.partitionBy("file_id", F.col("in_case_of_fire").isNull()).orderBy("seq")
    d = d.withColumn("_icf", F.row_number().over(order)).withColumn("_icf_twice", F.col("in_case_of_fire").isNotNull() & (F.col("_icf") > 1))
    d = d.withColumn("in_case_of_fire", F.when(~F.col("_icf_twice"), F.col("in_case_of_fire")))

    named = by_name & (F.col("room_id") > 0)
    office = named & F.col("f_office")
    rules = {
        "R2": on & F.col("f_variable"), "R1": by_name & ~office, "R5": office, "R6": F.col("suite_id").isNotNull(), "R7": F.col("restroom").isNotNull(),
        "R8": F.col("restroom").isNotNull() & F.col("n_accessible"), "R9": F.col("exit").isNotNull(), "R10": F.col("max_occupancy").isNotNull(), "R11": F.col("stair_landing").isNotNull(),
        "R12": on & F.col("f_elevator"), "R13": F.col("evacuation_map").isNotNull(), "R14": F.col("office_directory").isNotNull(),
    }
    nothing = on & plain & ~F.col("f_mep") & F.col("room_id").isNull() & F.col("room_id_insert").isNull() & F.col("suite_id").isNull()
    no_plaque = on & F.col("f_restroom") & ~F.col("has_plaque")
    doors_unknown = named & F.col("f_assembly") & door.isNull()
    load_unknown = on & F.col("f_assembly") & load.isNull()
    counted = lambda rule, what: F.when(door.isNotNull(), F.concat(F.lit(f"{rule}: {what} by door count "), door.cast("string"))).otherwise(F.lit(f"{rule}: {what} assumed 1, door count unknown"))
    notes = joined_notes(
        F.when(on & F.col("f_variable"), counted("R2", "variable use")),
        F.when(named & F.col("f_assembly"), counted("R3", "assembly doors")),
        F.when(office, counted("R5", "office doors")),
        F.when(F.col("suite_id").isNotNull(), F.lit("R6: suite entry assumed 1")),
        F.when(no_plaque, F.lit("R7/R8: no plaque entry, type unknown")),
        F.when(on & F.col("f_assembly") & load.isNull() & ~(outlet | lobby), F.lit("R9: two exits assumed, load unknown")),
        F.when(load_unknown, F.lit("R10: capacity to be verified, load unknown")),
        F.when(F.col("stair_landing").isNotNull(), counted("R11", "stair corridor")),
    )
    reasons = F.array_compact(
        F.array(
            F.when(F.col("_stop") == "R15", "R15: mezzanine MEP"),
            F.when(F.col("_near"), "R15-near-veto"),
            F.when(F.col("_stop") == "R4", "R4: corridor or hall"),
            F.when(F.col("_stop") == "MEP", "excluded: MEP"),
            F.when(F.col("_stop") == "BAY", "excluded: vehicle bay"),
            F.when(F.col("_icf_twice"), "R12: in-case-of-fire sign is at another elevator"),
        )
    )
    signs = sum((F.coalesce(F.col(q), F.lit(0)) for q in QUANTITIES), F.lit(0))
    reason = (
        F.when(signs > 0, F.lit(None))
        .when(F.col("_stop") == "R15", "VETOED_MEZZANINE")
        .when((F.col("_stop") == "MEP") | F.col("_near"), "VETOED_MEP")
        .when(F.col("_stop").isin("R4", "BAY"), "EXPLICIT_EXCLUSION")
        .when(nothing, "NO_RULE_MATCH")
        .when(~F.col("f_mep") & ~F.col("f_corridor") & ~F.col("f_bay"), "CLASSIFICATION_FAILURE")
        .otherwise("EXTRACTION_MISS")
    )
    kept = ("file_id", "seq", "room_number", "room_name", "level", "pdf_page", "zone_qualifier")
    return d.select(
        *kept,
        *QUANTITIES,
        F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()])).alias("applied_rules"),
        reasons.alias("exclusion_reasons"),
        (doors_unknown | no_plaque | load_unknown | nothing).alias("ambiguous"),
        F.when(nothing, F.lit("NO_RULE_MATCH")).otherwise(F.nullif(notes, F.lit(""))).alias("ambiguity_note"),
        reason.alias("reason"),
        F.col("f_stair").alias("is_stair"),
        F.col("f_elevator").alias("is_elevator"),
    )


def sign_rows(assignments: DataFrame) -> DataFrame:
    """One row for each sign type with a quantity over 0."""
    entries = F.array(*[F.struct(F.lit(t).alias("sign_type"), F.col(q).alias("quantity"), F.lit(r).alias("rule")) for q, t, r in SIGNS])
    zone = F.col("zone_qualifier")
    base = slug(F.col("room_name"))
    ident = F.coalesce("room_number", F.when(zone.isNotNull(), F.concat(F.substring(base, 1, 32), F.lit(" ["), zone, F.lit("]"))).otherwise(base))
    where = F.when(zone.isNotNull(), F.concat("room_name", F.lit(" — "), zone)).otherwise(F.col("room_name"))
    return assignments.select(
        "file_id", "seq", F.explode(F.filter(entries, lambda e: e["quantity"] > 0)).alias("e"), ident.alias("sign_identifier"), where.alias("location"), F.col("pdf_page").alias("page_number"),
        F.when(F.col("ambiguous"), 0.7).otherwise(1.0).alias("confidence_score"), F.col("ambiguous").alias("review_flag"), F.col("ambiguity_note").alias("exception_reason"), "level",
    ).select("file_id", "seq", "e.*", "sign_identifier", "location", "page_number", "confidence_score", "review_flag", "exception_reason", "level")


def decision_log(assignments: DataFrame) -> DataFrame:
    """One line of text for each room: rules, signs and exclusions."""
    shown = [F.when(F.col(q) > 0, F.concat(F.lit(t.title() + " x"), F.col(q).cast("string"))) for q, t, _ in SIGNS]
    signs = F.concat_ws(", ", *shown)
    return assignments.select(
        "file_id", "seq",
        F.concat_ws(" ", F.lit("Room"), "room_number", "room_name", F.concat(F.lit("["), "level", F.lit("]")), F.when(F.size("applied_rules") > 0, F.concat(F.lit("-> "), F.array_join("applied_rules", ", "))),
                    F.when(signs == "", "| no signs").otherwise(F.concat(F.lit("| "), signs)), F.when(F.size("exclusion_reasons") > 0, F.concat(F.lit("("), F.array_join("exclusion_reasons", "; "), F.lit(")")))).alias("entry"),
    )


def zero_sign_summary(assignments: DataFrame) -> DataFrame:
    """Rooms without signs by reason, with their names in order."""
    label = F.concat("room_name", F.coalesce(F.concat(F.lit(" ("), "room_number", F.lit(")")), F.lit("")))
    names = F.transform(F.array_sort(F.collect_list(F.struct("file_id", "seq", label.alias("v")))), lambda s: s["v"])
    return assignments.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("rooms"), F.array_join(names, ", ").alias("names"))


def page_audit(assignments: DataFrame) -> DataFrame:
    """Per page: rooms found, sign rows, quantity, room names in order."""
    per = [F.when(F.col(q) > 0, F.col(q)).otherwise(0) for q in QUANTITIES]
    kinds = [F.when(F.col(q) > 0, 1).otherwise(0) for q in QUANTITIES]
    names = F.transform(F.array_sort(F.collect_list(F.struct("seq", "room_name"))), lambda s: s["room_name"])
    return assignments.groupBy("file_id", "pdf_page").agg(F.count("*").alias("rooms_found"), F.sum(sum(kinds, F.lit(0))).alias("rows_emitted"), F.sum(sum(per, F.lit(0))).alias("quantity"), names.alias("rooms"))
