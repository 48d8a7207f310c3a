"""Conversation repair: cost layers over the turns, bitsets of grammar states, and the least audit by tracing them back.

The roles that are kept must read ``(s?(ua)+)?``: four states (nothing yet, after s, after u, after a). For each
cost 0, 1, 2, ... a layer holds for every turn the set of states, as bits, from which the rest can be finished at exactly
that cost; a layer comes from those 0, 1, 2, 5 or 6 below it through tables of the sixteen sets. The first layer
whose set at the first turn holds the start gives the cost; going forward through the layers and taking the least letter that
stays on them gives the least audit.

Layers are made over blocks of turns, so that a long conversation costs as much per turn as a short one. Conversations
are cut into pieces along a range partitioning by conversation and turn, so that a conversation of any length is spread
over the tasks: the costs of a piece from state to state are a small matrix, the costs behind each piece follow from
the matrices, each piece is traced from each state in parallel, and a pass over the pieces says which trace holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drawlake.llm.common import frame, materialize, table, whole_text_batches
from drawlake.llm.spelling import CRC, CRC_TABLE

#: Turns under one set of layers; turns and characters of a piece at most (a piece holds at least one turn).
BLOCK, PIECE, CHARS = 16, 4096, 4_000_000
DELETE, INSERT, REROLE, CUT = 2, 5, 1, 5
NEVER = 1 << 60
_SPACES = " \t\n\x0b\x0c\r"
START, S, U, A = range(4)
#: Where a role's initial leads from each state (None: nowhere), and where the next user or assistant turn does.
STEP = {"s": (S, None, None, None), "u": (U, U, None, U), "a": (None, None, A, None)}
ALTERNATE = (U, U, A, U)
#: Cost to an accepting state behind the last turn: after s two turns are missing, after u one.
ENDS = (0, 2 * INSERT, INSERT, 0)


def _sources(step: tuple) -> tuple[int, ...]:
    """For each set of states the set of those that ``step`` leads into it."""
    return tuple(sum(1 << q for q in range(4) if step[q] is not None and into >> step[q] & 1) for into in range(16))


_KEEP, _TURN, _NONE = {c: _sources(step) for c, step in STEP.items()}, _sources(ALTERNATE), (0,) * 16


def layers(turns: list[tuple[str, str]], ends: tuple[int, ...], wanted: int) -> list[list[int]]:
    """Sets of states by cost and turn, up to the layer where all states of ``wanted`` have been seen at the first turn.

    ``turns``: initial of the role and fault. ``ends``: cost behind the last turn by state, its least taken off.
    """
    n, out, seen = len(turns), [], 0
    last = 2 * n + max([e for e in ends if e < NEVER], default=0) + 2 * INSERT
    for d in range(last + 1):
        now = [0] * n + [sum(1 << q for q in range(4) if ends[q] == d)]
        for j in range(n - 1, -1, -1):
            initial, fault = turns[j]
            states = out[d - DELETE][j + 1] if d >= DELETE else 0
            if d >= INSERT:
                states |= _TURN[out[d - INSERT][j]]
            if fault in ("", "truncated"):
                left = d - CUT if fault else d
                if left >= 0:
                    states |= _KEEP.get(initial, _NONE)[now[j + 1] if left == d else out[left][j + 1]]
                if left >= REROLE:
                    states |= _TURN[out[left - REROLE][j + 1]]
            now[j] = states
        out.append(now)
        seen |= now[0]
        if seen & wanted == wanted:
            break
    return out


def _costs(found: list[list[int]]) -> tuple[int, ...]:
    return tuple(next((d for d, layer in enumerate(found) if layer[0] >> q & 1), NEVER) for q in range(4))


def _blocks(turns: list) -> list[list]:
    return [turns[k : k + BLOCK] for k in range(0, len(turns), BLOCK)]


def _behind(turns: list, ends: tuple[int, ...], wanted: int = 15) -> tuple[tuple[int, ...], list]:
    """Costs from the first turn by state, and the blocks with their layers; ``wanted`` are the states asked for there."""
    kept, blocks = [], _blocks(turns)
    for k in range(len(blocks) - 1, -1, -1):
        least = min(ends)
        found = layers(blocks[k], tuple(e - least if e < NEVER else NEVER for e in ends), 15 if k else wanted)
        kept.append((blocks[k], found))
        ends = tuple(least + c if c < NEVER else NEVER for c in _costs(found))
    return ends, kept[::-1]


def matrix(turns: list) -> list[int]:
    """Least costs over the turns from each state to each, row by row; inserts stand before a turn, those behind the last belong to what follows."""
    columns = [_behind(turns, tuple(0 if q == end else NEVER for q in range(4)))[0] for end in range(4)]
    return [columns[end][begin] for begin in range(4) for end in range(4)]


def _trace(blocks: list, state: int) -> tuple[str, int]:
    """The least letters from ``state`` along the layers, and the state behind them."""
    letters = []
    for turns, found in blocks:
        d = next(k for k, layer in enumerate(found) if layer[0] >> state & 1)
        j = 0
        while j < len(turns):
            initial, fault = turns[j]
            left = d - CUT if fault else d
            kept = STEP.get(initial, (None,) * 4)[state]
            if d >= DELETE and found[d - DELETE][j + 1] >> state & 1:
                letter, d, j = "D", d - DELETE, j + 1
            elif d >= INSERT and found[d - INSERT][j] >> ALTERNATE[state] & 1:
                letter, d, state = "I", d - INSERT, ALTERNATE[state]
            elif left >= 0 and kept is not None and fault in ("", "truncated") and found[left][j + 1] >> kept & 1:
                letter, d, state, j = "K", left, kept, j + 1
            else:
                letter, d, state, j = "R", left - REROLE, ALTERNATE[state], j + 1
            letters.append(letter)
    return "".join(letters), state


def least_edits(turns: list[tuple[str, str]]) -> tuple[int, str]:
    """Cost and least audit of a whole conversation of ``(initial, fault)``."""
    costs, blocks = _behind(turns, ENDS, 1)
    letters, state = _trace(blocks, START)
    return costs[START] if turns else 0, letters + "I" * (ENDS[state] // INSERT)


_ROW = "struct<turn: bigint, role: string, text: string, fault: string>"
_EDIT = "struct<edit: string, turn: bigint, role: string, was: string, text: string, fault: string>"


def _edits(rows: list, letters: str, state: int) -> list[dict]:
    """The rows with what is done to them, roles as they come out; inserted turns are without text and number."""
    out, at = [], iter(rows)
    for letter in letters:
        row = {"turn": None, "role": "", "text": "", "fault": ""} if letter == "I" else next(at)
        role = row["role"]
        if letter in "IR":
            state = ALTERNATE[state]
            role = "user" if state == U else "assistant"
        elif letter == "K":
            state = STEP[role[:1]][state]
        out.append({"edit": letter, "turn": row["turn"], "role": role, "was": row["role"], "text": row["text"], "fault": row["fault"]})
    return out


def _turns(rows: list) -> list[tuple[str, str]]:
    return [(r["role"][:1], r["fault"]) for r in rows]


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows -> pieces. The first and the last conversation of a task may go on in another one and count as cut."""
    number = TaskContext.get().partitionId() << 32
    names = ["conv", "piece", "is_whole", "costs", "rows"]
    rows, size, now, cut_before, previous, ready, held = [], 0, None, True, None, [], 0

    def piece(is_whole: bool) -> tuple:
        return now, number, is_whole, None if is_whole else matrix(_turns(rows)), rows

    for b in batches:
        for conv, turn, no_turn, role, text, fault, key, at_first in zip(*(b[c].tolist() for c in b.columns), strict=True):
            other = conv != now
            if rows and (other or len(rows) >= PIECE or size > CHARS):
                ready.append(piece(other and not cut_before))
                number, held, cut_before, rows, size = number + 1, held + size, not other, [], 0
                if len(ready) >= 1000 or held > CHARS:
                    yield frame(ready, names)
                    ready, held = [], 0
            now = conv
            # Of equal rows at the first place of all the first one is no duplicate; they follow each other.
            repeats, previous = not at_first or key == previous, key
            rows.append({"turn": None if no_turn else turn, "role": role, "text": text, "fault": "blank" if fault == "blank" else "duplicate" if repeats else fault})
            size += len(text)
    if rows:
        ready.append(piece(False))
    yield frame(ready, names)


def _costs_behind(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces of a conversation from the last to the first -> the costs behind each of them, by state."""
    now, ends = None, ENDS
    for b in batches:
        out = []
        for conv, number, costs in b.itertuples(index=False):
            is_last = conv != now
            now, ends = conv, ENDS if is_last else ends
            out.append((number, list(ends), is_last))
            ends = tuple(min(int(costs[4 * q + r]) + ends[r] for r in range(4)) for q in range(4))
        yield frame(out, ["piece", "ends", "is_last"])


def _traces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each piece's least letters from every state, with the state behind them."""
    for b in batches:
        out = []
        for conv, number, initials, faults, ends, is_last in b.itertuples(index=False):
            _, blocks = _behind(list(zip(initials, faults, strict=True)), tuple(int(e) for e in ends))
            found = [_trace(blocks, q) for q in range(4)]
            out.append((conv, number, [t + ("I" * (ENDS[q] // INSERT) if is_last else "") for t, q in found], [q for _, q in found]))
        yield frame(out, ["conv", "piece", "letters", "states"])


def _chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces of a conversation in order -> the trace that holds, with the state before it as first character."""
    now, state = None, START
    for b in batches:
        out = []
        for conv, number, letters, states in b.itertuples(index=False):
            state = state if conv == now else START
            now = conv
            out.append((number, f"{state}{letters[state]}"))
            state = int(states[state])
        yield frame(out, ["piece", "trace"])


def _applied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for conv, number, is_whole, rows, trace in b.itertuples(index=False):
            rows = [x | {"turn": None if x["turn"] is None else int(x["turn"])} for x in rows]
            trace = f"{START}{least_edits(_turns(rows))[1]}" if is_whole else trace
            out.append((conv, number, is_whole, _edits(rows, trace[1:], int(trace[0]))))
        yield frame(out, ["conv", "piece", "is_whole", "edits"])


def _name(conv_id: Column) -> Column:
    """A conversation's id as a string that is never null, from which ``_id`` gets it back."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def _id(name: Column, kind: str) -> Column:
    return F.when(name != "", F.expr("substring(conv, 2)").cast(kind))


def repair(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows of conversations -> ``conv_id, piece, is_whole, edits``: one row for a conversation, or one for each piece of a cut one, in order of ``piece``.

    ``edits`` are structs of ``edit`` (Keep, Rerole, Delete, Insert by initial), ``turn, role, was`` (the role before), ``text,
    fault``, deleted rows with them. Rows go by turn (nulls first), ties by role and the SHA-256 of the text; repeated rows are duplicates of
    the first. A null role or text is one space, a null conv_id is a conversation of its own; empty texts are blank; a role
    of another initial than s, u or a cannot be kept. No rows in, no rows out. Other columns are ignored.
    """
    whole_text_batches(conversations.sparkSession)
    space, turn_ = F.lit(" "), F.col(turn).cast("long")
    rows = conversations.select(
        _name(F.col(conv_id)).alias("conv"), F.coalesce(turn_, F.lit(0)).alias("turn"), turn_.isNull().alias("no_turn"),
        F.coalesce(F.col(role).cast("string"), space).alias("role"), F.coalesce(F.col(text).cast("string"), space).alias("text"),
    )
    rows = rows.withColumn("digest", F.sha2("text", 256)).withColumn("key", F.sha2(F.concat(F.length("conv").cast("string"), "conv", "role", "digest"), 256))
    # Where rows of a conversation are equal: the turn of the first. A table of its own, so that the join can split a frequent key.
    place = F.struct((~F.col("no_turn")).alias("numbered"), "turn")
    firsts = rows.groupBy("key").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    firsts = materialize(firsts.select("key", "first"), "first-rows")
    kept = F.rtrim("text", F.lit(_SPACES))
    fault = F.when(kept == "", "blank").when(~F.right(kept, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    rows = rows.withColumn("fault", fault).join(firsts, "key", "left").withColumn("at_first", F.col("first").isNull() | (F.col("first") == place))
    order = ["conv", F.col("no_turn").desc(), "turn", "role", "digest"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "no_turn", "role", "text", "fault", "key", "at_first")
    pieces = materialize(rows.mapInPandas(_pieces, f"conv string, piece bigint, is_whole boolean, costs array<bigint>, rows array<{_ROW}>"), "conversation-pieces")

    cut = pieces.where("NOT is_whole")
    back = cut.select("conv", "piece", "costs").repartition("conv").sortWithinPartitions("conv", F.col("piece").desc())
    back = materialize(back.mapInPandas(_costs_behind, "piece bigint, ends array<bigint>, is_last boolean"), "costs-behind")
    light = cut.select("conv", "piece", F.expr("transform(rows, r -> left(r.role, 1))").alias("initials"), F.col("rows.fault").alias("faults")).join(back, "piece")
    traces = light.select("conv", "piece", "initials", "faults", "ends", "is_last").mapInPandas(_traces, "conv string, piece bigint, letters array<string>, states array<bigint>")
    held = traces.repartition("conv").sortWithinPartitions("conv", "piece").mapInPandas(_chosen, "piece bigint, trace string")
    solved = pieces.drop("costs").join(materialize(held, "held-traces"), "piece", "left").select("conv", "piece", "is_whole", "rows", "trace")
    solved = solved.mapInPandas(_applied, f"conv string, piece bigint, is_whole boolean, edits array<{_EDIT}>")
    return solved.select(_id(F.col("conv"), conversations.schema[conv_id].dataType.simpleString()).alias("conv_id"), "piece", "is_whole", "edits")


def edit_cost(edits: Column) -> Column:
    """What the edits cost together."""
    one = lambda e: F.when(e["edit"] == "D", DELETE).when(e["edit"] == "I", INSERT).otherwise(F.when(e["edit"] == "R", REROLE).otherwise(0) + F.when(e["fault"] == "truncated", CUT).otherwise(0))
    return F.aggregate(F.transform(edits, one), F.lit(0).cast("long"), lambda a, b: a + b.cast("long"))


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces of conversations in order -> the hash of each conversation's lines, which takes one piece after the other."""
    now, digest, empty = None, None, True
    for b in batches:
        for conv, lines, repaired in b.itertuples(index=False):
            if conv != now:
                if digest is not None:
                    yield frame([(now, digest.hexdigest())], ["conv", "repaired_sha256"])
                now, digest, empty = conv, hashlib.sha256(), True
            if lines:
                digest.update((repaired if empty else "\n" + repaired).encode())
                empty = False
    if digest is not None:
        yield frame([(now, digest.hexdigest())], ["conv", "repaired_sha256"])


def repair_digests(pieces: DataFrame) -> DataFrame:
    """What ``repair`` gives, read from a table -> one row per conversation: faults, cost, audit, and the hash of the repaired ``role:text`` lines.

    A hash goes through its lines in order: those of a cut conversation pass one task, a piece at a time.
    """
    had = F.filter("edits", lambda e: e["edit"] != "I")
    lines = F.transform(F.filter("edits", lambda e: e["edit"] != "D"), lambda e: F.concat(e["role"], F.lit(":"), e["text"]))
    d = pieces.select(
        _name(F.col("conv_id")).alias("conv"), "piece", "is_whole", had.alias("had"), edit_cost(F.col("edits")).alias("cost"),
        F.array_join(F.transform("edits", lambda e: e["edit"]), "").alias("audit"), F.size(lines).alias("lines"), F.array_join(lines, "\n").alias("repaired"),
    ).withColumn("initials", F.expr("transform(had, e -> left(e.was, 1))")).withColumn("turns", F.expr("filter(had.turn, t -> t IS NOT NULL)"))
    faults = [F.expr(f"size(filter(had, e -> e.fault = '{f}'))").cast("long").alias(f) for f in ("blank", "duplicate", "truncated")]
    legal = "('su', 'ua', 'au')"
    illegal = F.expr(f"size(filter(zip_with(slice(initials, 1, size(initials) - 1), slice(initials, 2, size(initials)), (a, b) -> a || b), p -> p NOT IN {legal}))").cast("long")
    d = d.select("conv", "piece", "is_whole", "cost", "audit", "lines", "repaired", *faults, illegal.alias("illegal"), F.array_min("turns").alias("low"), F.array_max("turns").alias("high"), F.size(F.array_distinct("turns")).cast("long").alias("n_turns"), F.expr("initials[0]").alias("first"), F.element_at("initials", -1).alias("last"), F.expr("had[0].turn").alias("first_turn"), F.expr("element_at(had, -1).turn").alias("last_turn"))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("n_turns"), F.lit(0).cast("long")).alias("gaps")
    names = ("blank", "duplicate", "truncated", "illegal", "cost")

    cut = d.where("NOT is_whole")
    hashes = cut.select("conv", "piece", "lines", "repaired").repartition("conv").sortWithinPartitions("conv", "piece").drop("piece").mapInPandas(_hashed, "conv string, repaired_sha256 string")
    before = Window.partitionBy("conv").orderBy("piece")
    seam = F.concat(F.lag("last").over(before), F.col("first"))
    cut = cut.drop("lines", "repaired").withColumn("illegal", F.col("illegal") + F.when(seam.isin("su", "ua", "au") | seam.isNull(), 0).otherwise(1))
    cut = cut.withColumn("n_turns", F.col("n_turns") - F.when(F.lag("last_turn").over(before) == F.col("first_turn"), 1).otherwise(0))
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "audit"))), lambda p: p["audit"]), "")
    joined = cut.groupBy("conv").agg(*[F.sum(c).alias(c) for c in (*names, "n_turns")], F.min("low").alias("low"), F.max("high").alias("high"), audit.alias("audit")).join(hashes, "conv")
    out = ["conv", gaps, *names, "audit", "repaired_sha256"]
    both = d.where("is_whole").withColumn("repaired_sha256", F.sha2("repaired", 256)).select(*out).unionByName(joined.select(*out))
    return both.select(_id(F.col("conv"), pieces.schema["conv_id"].dataType.simpleString()).alias("conv_id"), "gaps", *names, "audit", "repaired_sha256")


def damaged(conversations: DataFrame, one_in: int = 20) -> DataFrame:
    """Rows as the CRC of ``conv_id:turn`` damages them: dropped, emptied, robbed of their full stops, repeated, or said by the user. Nulls are one space."""
    text_or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_or_space("conv_id"), F.lit(":"), text_or_space("turn")).cast("binary")) % one_in
    d = conversations.select("conv_id", "turn", text_or_space("role").alias("role"), text_or_space("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return d.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))).drop("col")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired; those without a row left are rows of zeros."""
    conversations = table(spark, sf_dir, "conversations")
    found = materialize(repair_digests(materialize(repair(damaged(conversations)), "repaired")), "repair-digests")
    zeros = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0}
    known = found.select(F.col("conv_id").alias("known"))
    ids = conversations.select("conv_id").distinct()
    gone = ids.join(known, ids["conv_id"].eqNullSafe(known["known"]), "left_anti")
    gone = gone.select("conv_id", *[F.lit(v).cast("long").alias(k) for k, v in zeros.items()], F.lit("").alias("audit"), F.sha2(F.lit(""), 256).alias("repaired_sha256"))
    return found.unionByName(gone)


def _best(*states: str) -> str:
    """SQL: the least of some states (cost, audit, lines) that are not null."""
    return f"list_sort(list_filter([{', '.join(states)}], lambda x: x IS NOT NULL))[1]"


def _then(state: str, cost: str, letter: str, line: str = "''") -> str:
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t || {line}}} END"


def _inserted(name: str) -> str:
    """SQL: a select of states z, s, u, a from ``name`` in which turns may have been inserted."""
    user, assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    once = f"SELECT * REPLACE ({_best('u', *[_then(q, '5', 'I', user) for q in 'zsa'])} AS u, {_best('a', _then('u', '5', 'I', assistant))} AS a) FROM"
    return f"{once} ({once} ({once} {name}))"


SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 {CRC.format(x="(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS k FROM conversations, crc),
hurt AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
                CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) FROM given WHERE k <> 0),
placed AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS j,
                  regexp_replace(text, '[ 	-
]+$', '') AS kept FROM hurt),
faulty AS (SELECT *, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY j) AS i0,
                  CASE WHEN kept = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY j) > 1 THEN 'duplicate'
                       WHEN right(kept, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed),
steps AS (SELECT conv_id, j, i, fault IN ('blank', 'duplicate') AS must, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS pen, chr(10) || role || ':' || text AS line,
                 chr(10) || 'user:' || text AS uline, chr(10) || 'assistant:' || text AS aline FROM faulty),
run(conv_id, j, z, s, u, a) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, {{'c': 0::BIGINT, 'a': '', 't': ''}}, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR), NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR), NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) FROM steps
  UNION ALL
  SELECT conv_id, j + 1, {_then('z', '2', 'D')},
         {_best(_then('s', '2', 'D'), f"CASE WHEN NOT must AND i = 's' THEN {_then('z', 'pen', 'K', 'line')} END")},
         {_best(_then('u', '2', 'D'), *[f"CASE WHEN NOT must AND i = 'u' THEN {_then(q, 'pen', 'K', 'line')} END" for q in 'zsa'], *[f"CASE WHEN NOT must THEN {_then(q, 'pen + 1', 'R', 'uline')} END" for q in 'zsa'])},
         {_best(_then('a', '2', 'D'), f"CASE WHEN NOT must AND i = 'a' THEN {_then('u', 'pen', 'K', 'line')} END", f"CASE WHEN NOT must THEN {_then('u', 'pen + 1', 'R', 'aline')} END")}
  FROM ({_inserted('(SELECT r.conv_id, r.j, z, s, u, a, i, must, pen, line, uline, aline FROM run r JOIN steps t ON r.conv_id IS NOT DISTINCT FROM t.conv_id AND t.j = r.j + 1)')})),
ends AS (SELECT conv_id, {_best('z', 'a')} AS e FROM ({_inserted('(SELECT conv_id, j, z, s, u, a FROM run WHERE j > 0 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY j DESC) = 1)')})),
told AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
                count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE (i0 || i) NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(e.c, 0)::BIGINT AS cost, coalesce(e.a, '') AS audit, sha256(coalesce(substring(e.t, 2), '')) AS repaired_sha256
FROM ids LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM ids.conv_id
"""
