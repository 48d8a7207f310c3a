"""Secret scans over a trigram inverted index, in DataFrame operations only.

Each rule's pattern is read once by the driver and turned into a Boolean query over trigrams (all of one of several
alternatives, for each stretch of mandatory text). The postings hold, for every trigram of any query, the documents
that contain it; looking the queries up and counting an alternative's trigrams per document intersects them. Only the
documents a query leaves are verified with the rule's pattern. Rules without mandatory trigrams scan every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drawlake.llm.common import documents, materialize, whole


@dataclass(frozen=True)
class Rule:
    """``group``: the group whose length must reach ``least``."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


#: Base rules come first; their order is the order of kinds.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),  # the runs of AKIA[A-Z0-9]+ with 20 characters or more
    Rule("hex", r"[0-9a-f]{24,}", base=True),  # the runs of [0-9a-f]+ with 24 characters or more
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
#: Strings that a stretch of a pattern may stand for before it counts as open.
MOST_STRINGS = 40


def _exact(nodes) -> set[str] | None:
    """The strings a piece of a pattern matches, lowered, or None if there are too many."""
    out = {""}
    for op, arg in nodes:
        if op is C.LITERAL:
            more = {chr(arg).lower()}
        elif op is C.IN and all(o is C.LITERAL for o, _ in arg):
            more = {chr(a).lower() for _, a in arg}
        elif op is C.SUBPATTERN:
            more = _exact(arg[3])
        elif op is C.BRANCH:
            parts = [_exact(b) for b in arg[1]]
            more = None if None in parts else set().union(*parts)
        elif op is C.MAX_REPEAT and arg[1] == 1:
            one = _exact(arg[2])
            more = one and one | ({""} if arg[0] == 0 else set())
        else:
            more = None
        if more is None or len(out) * len(more) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Stretches of mandatory text; of each, alternatives; of each, its trigrams (lowered). No stretch: the rule scans fully."""
    stretches, now = [], {""}

    def close():
        nonlocal now
        sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in now}
        if all(sets):
            stretches.append([s for s in sorted(sets, key=sorted) if not any(o < s for o in sets)])
        now = {""}

    for node in _parser.parse(pattern):
        more = _exact([node])
        if more is not None and len(now) * len(more) <= MOST_STRINGS:
            now = {a + b for a in now for b in more}
        else:
            close()
            now = more or {""}
    close()
    return stretches


def _clauses(rules) -> list[tuple[str, int, int, int, int]]:
    """``(trigram, stretch, alternative, bit, full)``: a document meets an alternative when its bits are full."""
    rows, stretch, alternative = [], 0, 0
    for rule in rules:
        for choices in trigram_query(rule.pattern):
            for grams in choices:
                rows += [(g, stretch, alternative, 1 << b, (1 << len(grams)) - 1) for b, g in enumerate(sorted(grams))]
                alternative += 1
            stretch += 1
    return rows


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """``key, trigram`` for each of the trigrams a text (``key, low``) holds."""
    held = F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in trigrams]))
    return docs.select("key", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules) -> DataFrame:
    """``key, met`` of ``key, low``: a bit for each stretch that a document meets. Rows that share a key share their bits."""
    clauses = _clauses(rules)
    values = ", ".join("('{}', {}, {}L, {}L)".format(g.replace("\\", "\\\\").replace("'", "\\'"), s, b | a << 40, f | a << 40) for g, s, a, b, f in clauses)
    query = docs.sparkSession.sql(f"SELECT * FROM VALUES {values} AS q(trigram, stretch, bit, full)")
    found = postings(docs, sorted({c[0] for c in clauses})).join(F.broadcast(query), "trigram")  # the rules' own table
    met = found.groupBy("key", "stretch", "full").agg(F.bit_or("bit").alias("bits")).where("bits = full")
    return met.groupBy("key").agg(F.bit_or(F.expr("shiftleft(1L, stretch)")).alias("met"))


def _matches(text: Column, rule: Rule) -> Column:
    rx = F.lit(rule.pattern)
    group = F.regexp_extract_all(text, rx, F.lit(rule.group))
    return F.struct(F.regexp_extract_all(text, rx, F.lit(0)).alias("m"), group.alias("g"), F.split(text, rule.pattern, -1).alias("p"))


def _spans(found: str, rank: int, rule: Rule) -> Column:
    """Spans of the matches. A match ends behind all pieces and matches up to it: running sums of their lengths, by doubling steps, so that n matches cost n log n."""
    lengths = f"transform({found}.m, (x, i) -> length({found}.p[i]) + length(x))"
    steps = f"sequence(0, cast(floor(log2(greatest(size({found}.m), 1))) AS int))"
    ends = f"aggregate({steps}, {lengths}, (a, k) -> transform(a, (x, i) -> x + IF(i >= shiftleft(1, k), a[i - shiftleft(1, k)], 0)))"
    span = f"named_struct('start', e - length({found}.m[i]), 'rank', {rank}, 'end', e, 'ok', length({found}.g[i]) >= {rule.least})"
    return F.expr(f"filter(transform({ends}, (e, i) -> {span}), s -> s.ok)")


def scan_secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, text, spans``: an array of (start, rank of the rule, end, ok) by start, then rank; code points, end exclusive.

    A null text counts as empty and has no spans. Rows with equal id and text share an index key, which changes
    nothing: candidates are verified on each row's own text. Other columns are ignored.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), whole(F.col(text)).alias("text"))
    d = d.withColumn("key", F.xxhash64("doc_id", "text"))
    # Written, so that the join knows how few the candidates are: texts stay where they are while a broadcast holds them, and
    # beyond that both sides are shuffled and hot keys can be split.
    found = materialize(candidates(d.select("key", F.lower("text").alias("low")), rules), "secret-candidates")
    d = d.join(found, "key", "left")
    stretch, names = 0, []
    for rank, rule in enumerate(rules):
        n = len(trigram_query(rule.pattern))
        mask = ((1 << n) - 1) << stretch
        stretch += n
        wanted = F.col("met").bitwiseAND(F.lit(mask)) == mask if n else F.col("text").rlike(rule.pattern)
        d = d.withColumn(f"f{rank}", F.when(wanted & F.col("text").rlike(rule.pattern), _matches(F.col("text"), rule)))
        names.append(f"f{rank}")
    none = "cast(array() AS array<struct<start:int,rank:int,end:int,ok:boolean>>)"
    each = [F.when(F.col(n).isNull(), F.expr(none)).otherwise(_spans(n, rank, rule)) for rank, (n, rule) in enumerate(zip(names, rules, strict=True))]
    return d.select("doc_id", "text", F.array_sort(F.concat(*each)).alias("spans"))


def _joined(spans: str, rules) -> Column:
    kinds = ", ".join(f"'{r.kind}'" for r in rules)
    return F.expr(f"array_join(transform({spans}, s -> concat(array({kinds})[s.rank], ':', s.start, ':', s.end)), ',')")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(documents(spark, sf_dir))
    base = sum(r.base for r in RULES)
    found = found.withColumn("base", F.filter("spans", lambda s: s["rank"] < base))
    counts = [F.expr(f"cast(size(filter(base, s -> s.rank = {k})) AS long)").alias(f"n_{r.kind}") for k, r in enumerate(RULES) if r.base]
    return found.select("doc_id", *counts, F.sha2(_joined("base", RULES), 256).alias("base_sha256"), _joined("spans", RULES).alias("spans"))


def _sql() -> str:
    each = []
    for k, r in enumerate(RULES):
        rx = r.pattern.replace("'", "''")
        each.append(f"""SELECT rid, {k} AS k, '{r.kind}' AS kind, {str(r.base).lower()} AS base, unnest(generate_series(1, len(m))) AS i, m, p, g FROM
          (SELECT rid, regexp_extract_all(t, '{rx}', 0) AS m, regexp_extract_all(t, '{rx}', {r.group}) AS g, string_split_regex(t, '{rx}') AS p FROM d WHERE regexp_matches(t, '{rx}'))""")
    least = " ".join(f"WHEN {k} THEN {r.least}" for k, r in enumerate(RULES))
    counts = ", ".join(f"count(*) FILTER (s.k = {k})::BIGINT AS n_{r.kind}" for k, r in enumerate(RULES) if r.base)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(each)}),
s AS (SELECT rid, k, kind, base, (list_sum([length(x) FOR x IN p[1:i]]) + coalesce(list_sum([length(x) FOR x IN m[1:i - 1]]), 0))::BIGINT AS a, length(m[i]) AS n
      FROM m WHERE length(g[i]) >= CASE k {least} END)
SELECT d.doc_id, {counts},
  sha256(coalesce(string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, k) FILTER (base), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, k), '') AS spans
FROM d LEFT JOIN s USING (rid) GROUP BY d.rid, d.doc_id
"""


SQL = _sql()
