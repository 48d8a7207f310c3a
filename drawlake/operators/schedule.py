"""Sign schedules: lines to sections, room headings, rows, legends and keynotes.

A line's section is that of the last header before it, and a row's room that of the last heading, so that both are
carried by windows over the lines of a column; nothing else about earlier lines matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawlake.functions import vocab as V
from drawlake.operators.windows import anchored_lines


def lines(items: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Items (``file_id, page, column, seq, text, x, y, w, h``) -> ``file_id, page, column, line, tokens``: tokens left to right."""
    key = ["file_id", "page", "column"]
    centre = items.withColumn("_cy", F.col("y") + F.col("h") / 2)
    grouped = anchored_lines(centre, key, "_cy", "seq", tolerance)
    d = centre.join(grouped, [*key, "seq"])
    tokens = F.transform(F.array_sort(F.collect_list(F.struct("x", "seq", F.trim("text").alias("t")))), lambda s: s["t"])
    return d.groupBy(*key, "line").agg(F.filter(tokens, lambda t: t != "").alias("tokens")).where(F.size("tokens") > 0)


def _token(i: int) -> Column:
    return F.coalesce(F.try_element_at("tokens", F.lit(i)), F.lit(""))


def _is(token: Column, pattern: str) -> Column:
    return token.rlike(pattern)


def headings(text: Column) -> Column:
    """The section that a line opens: schedule, type_legend, keynote_legend or diagram."""
    up = F.upper(text)
    return (
        F.when(up.contains("SIGNAGE SCHEDULE") | up.contains("SIGN SCHEDULE"), "schedule")
        .when(up.contains("SIGN TYPE LEGEND") | (up == "SIGN TYPES"), "type_legend")
        .when(up.contains("KEYNOTE"), "keynote_legend")
        .when(text.rlike(V.DIAGRAM_LABEL), "diagram")
    )


def room_heading(text: Column) -> Column:
    """(number, name) if the tokens are a room's heading: a prefix and a code, a known room by name, or a number that no sign row follows."""
    a, b, c = _token(1), _token(2), _token(3)
    row_after = _is(b, V.SIGN_TYPE_CODE) & _is(c, V.QUANTITY)
    prefixed = F.upper(a).isin(*V.HEADING_PREFIXES) & (F.size("tokens") >= 2)
    code = b.rlike("[0-9]") & b.rlike(r"^[A-Za-z0-9\-.]+$") & ~row_after
    named = F.forall("tokens", lambda t: t.rlike("^[A-Za-z']+$")) & (F.size("tokens") <= 4) & F.upper(F.regexp_replace(a, "'", "")).isin(*V.HEADING_ROOM_WORDS)
    numbered = _is(a, V.SCHEDULE_ROOM_NUMBER) & ~(_is(a, V.SIGN_TYPE_CODE) & _is(b, V.QUANTITY)) & ~row_after
    of = lambda n: F.struct(n.alias("number"), text.alias("name"))
    return F.when(prefixed, F.when(code, of(b))).when(named, of(text)).when(numbered, of(a))


def sign_row() -> Column:
    """(code, quantity, text, glass, comments) if the tokens are a sign's row."""
    counted = _is(_token(2), V.QUANTITY)
    rest = F.slice("tokens", F.when(counted, 3).otherwise(2), F.size("tokens"))
    yes = F.array_position(F.transform(rest, lambda t: t.rlike("(?i)^(?:yes|no)$")), True)
    join = lambda xs: F.nullif(F.trim(F.array_join(xs, " ")), F.lit(""))
    last = F.coalesce(F.try_element_at(rest, F.lit(-1)), F.lit(""))
    noted = last.rlike("^[A-Z](?:,[A-Z])*$")
    before = F.slice(rest, F.lit(1), F.greatest(F.size(rest) - 1, F.lit(0)))
    text = F.when(yes > 0, join(F.slice(rest, F.lit(1), F.greatest(yes - 1, F.lit(0)).cast("int")))).when(noted, join(before)).otherwise(join(rest))
    notes = F.when(yes > 0, join(F.slice(rest, (yes + 1).cast("int"), F.size(rest)))).when(noted, last)
    glass = F.when(yes > 0, F.lower(F.try_element_at(rest, F.greatest(yes, F.lit(1)).cast("int"))) == "yes")
    return F.when(
        _is(_token(1), V.SIGN_TYPE_CODE) & (F.size("tokens") >= 2),
        F.struct(F.upper(_token(1)).alias("code"), F.when(counted, _token(2).try_cast("int")).alias("quantity"), text.alias("signage_text"), glass.alias("glass_backer"), notes.alias("raw_comments")),
    )


def legend_row() -> Column:
    """(code, dimensions, material, features) if the tokens are a row of the type legend.

    The dimensions are the first stretch of tokens with a digit or a cross; what follows is material and features.
    """
    rest = F.slice("tokens", 2, F.size("tokens"))
    sized = F.transform(rest, lambda t: t.rlike("[0-9x×]") & t.rlike("[0-9]|^[x×]$"))
    begin = F.array_position(sized, True)
    after = F.array_position(F.slice(sized, F.greatest(begin, F.lit(1)).cast("int"), F.size(rest)), False)
    end = F.when(after > 0, begin + after - 2).otherwise(F.size(rest))
    has = (begin > 0) & F.array_join(rest, " ").rlike(r"\d[\d\s/]*[x×]\s*\d|" + V.DIMENSION)
    tail = F.when(has, F.slice(rest, (end + 1).cast("int"), F.size(rest))).otherwise(rest)
    dims = F.when(has, F.array_join(F.slice(rest, F.greatest(begin, F.lit(1)).cast("int"), F.greatest(end - begin + 1, F.lit(0)).cast("int")), " "))
    return F.when(
        _is(_token(1), V.SIGN_TYPE_CODE) & (F.size("tokens") >= 2),
        F.struct(F.upper(_token(1)).alias("code"), dims.alias("dimensions"), F.try_element_at(tail, F.lit(1)).alias("material"), F.slice(tail, 2, F.size(tail)).alias("features")),
    )


def parsed(lines_: DataFrame) -> DataFrame:
    """Lines with ``section`` (that of the last header), ``room`` (that of the last heading of a schedule) and the row they are."""
    key = ["file_id", "page", "column"]
    w = Window.partitionBy(*key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    d = lines_.withColumn("text", F.array_join("tokens", " "))
    d = d.withColumn("opens", headings(F.col("text")))
    d = d.withColumn("section", F.last("opens", True).over(w)).withColumn("table_name", F.last(F.when(F.col("opens") == "schedule", F.col("text")), True).over(w))
    inside = F.col("opens").isNull()
    d = d.withColumn("heading", F.when(inside & (F.col("section") == "schedule"), room_heading(F.col("text"))))
    none = F.struct(F.lit(None).cast("string").alias("number"), F.lit(None).cast("string").alias("name"))
    d = d.withColumn("room", F.last(F.when(F.col("opens") == "schedule", none).otherwise(F.col("heading")), True).over(w))
    rest = inside & F.col("heading").isNull()
    return d.withColumn("sign", F.when(rest & (F.col("section") == "schedule"), sign_row())).withColumn("legend", F.when(rest & (F.col("section") == "type_legend"), legend_row()))


def keynotes(parsed_: DataFrame) -> DataFrame:
    """``file_id, letter, description``; of a repeated letter the last counts."""
    k = parsed_.where("section = 'keynote_legend' AND opens IS NULL AND size(tokens) > 1").where(_is(_token(1), V.KEYNOTE_CODE))
    k = k.select("file_id", F.upper(_token(1)).alias("letter"), F.array_join(F.slice("tokens", 2, F.size("tokens")), " ").alias("description"), F.struct("page", "column", "line").alias("o"))
    return k.groupBy("file_id", "letter").agg(F.max_by("description", "o").alias("description"))


def specs(parsed_: DataFrame) -> DataFrame:
    """``file_id, code`` with the first dimensions, material and features that a legend gives, and whether a diagram shows it."""
    at = F.struct("page", "column", "line")
    rows = parsed_.where("legend IS NOT NULL").select("file_id", "legend.*", at.alias("o"), F.lit(False).alias("drawn"))
    label = parsed_.where("opens = 'diagram'").select("file_id", F.upper(F.regexp_extract("text", V.DIAGRAM_LABEL, 1)).alias("code"), at.alias("o"), F.lit(True).alias("drawn"))
    both = rows.unionByName(label, allowMissingColumns=True)
    first = lambda c, there: F.min_by(c, F.when(there, F.col("o")))
    return both.groupBy("file_id", "code").agg(first("dimensions", F.col("dimensions").isNotNull()).alias("dimensions"), first("material", F.col("material").isNotNull()).alias("material"), first("features", F.size("features") > 0).alias("features"), F.bool_or("drawn").alias("has_drawing"))


def entries(parsed_: DataFrame) -> DataFrame:
    """One row for each sign row with its room, its comments expanded by the keynotes, and its type's spec."""
    rows = parsed_.where("sign IS NOT NULL").select("file_id", "page", "column", "line", "table_name", F.col("room.number").alias("room_number"), F.col("room.name").alias("room_name"), "sign.*")
    notes = keynotes(parsed_).groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("letter", "description"))).alias("notes"))
    d = rows.join(notes, "file_id", "left").join(specs(parsed_), ["file_id", "code"], "left")
    codes = F.filter(F.split(F.coalesce("raw_comments", F.lit("")), r"[,\s]+"), lambda c: c != "")
    found = F.array_compact(F.transform(codes, lambda c: F.try_element_at("notes", F.upper(c))))
    return d.withColumn("expanded_comments", F.when(F.size(found) > 0, F.array_join(found, "; "))).drop("notes")


def codes_by_table(entries_: DataFrame) -> DataFrame:
    """Distinct codes, sorted, of each table; a table without a name is "Schedule" (T20)."""
    return entries_.groupBy(F.coalesce("table_name", F.lit("Schedule")).alias("table_name")).agg(F.array_sort(F.collect_set("code")).alias("codes"), F.count("*").alias("rows"))
