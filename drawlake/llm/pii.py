"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score.

Spans of the base kinds always count. Those of the added kinds (iban, ssn, birth, account) count from a score on: a
checksum alone reaches it, a bare pattern only beside a word that speaks for its kind and none that speaks against it.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from drawlake.llm.common import documents, whole_text_batches

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "birth", "account")
#: An added span (a kind that is not of the base) needs this score.
ADDED_SCORE = 0.5
#: Characters before and after a span in which context words count, as whole words.
REACH = 48
CONTEXT = {
    "email": ("mail", "contact", "write to"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "payment", "cvv"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
    "ssn": ("ssn", "social security", "national id", "taxpayer"),
    "birth": ("born", "birth", "dob"),
    "account": ("account", "acct", "routing"),
}
#: Words that speak against a kind.
AGAINST = {"ssn": ("part no", "order no", "isbn"), "birth": ("updated", "released", "version"), "account": ("order no", "tracking", "isbn")}
SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
DIGEST = "struct<n_email:long,n_ip:long,n_card:long,n_phone:long,base_sha256:string,spans:string,scores:string,max_score:double>"
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){15,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?a:\b)[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?a:\b)")
_SSN = re.compile(r"(?a:\b)[0-9]{3}-[0-9]{2}-[0-9]{4}(?a:\b)")
_BIRTH = re.compile(r"(?a:\b)(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/(?:19|20)[0-9]{2})(?a:\b)")
_ACCOUNT = re.compile(r"(?a:\b)[0-9]{8,12}(?a:\b)")
#: Characters of an IBAN by its country.
_IBAN_LENGTHS = {c: n for n, cs in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}.items() for c in cs.split()}
_ODD = str.maketrans("", "", " -")


def luhn(digits: str) -> bool:
    """Luhn's check over decimal digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if i % 2 == 0 else (v * 2 - 9 if v > 4 else v * 2)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The mod-97 check of an IBAN without blanks."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str):
    # From each @ to the left as far as characters of a local part go, the last match at most: no @ is one, so every
    # character is passed once and a text costs no more than its length.
    done = 0
    for m in _DOMAIN.finditer(text):
        left = at = m.start()
        while left > done and text[left - 1] in _LOCAL:
            left -= 1
        if done <= left < at:
            yield left, m.end()
            done = m.end()


def _ibans(text: str):
    # A match may take words that follow the number: the end that the country's length gives goes first, then the whole
    # match; of other countries, each end of a group from long to short. The search resumes behind what was accepted.
    at = 0
    while m := _IBAN.search(text, at):
        start, groups = m.start(), m[0].split(" ")
        size = _IBAN_LENGTHS.get(m[0][:2])
        ends = [(sum(map(len, groups[:k])), start + len(" ".join(groups[:k]))) for k in range(len(groups), 0, -1)]
        tries = [e for e in ends if e[0] >= 12] if size is None else [e for e in ends if e[0] == size] + ends[:1]
        at = start + 1
        for _, end in tries:
            if mod97(text[start:end].replace(" ", "")):
                yield start, end
                at = end
                break


def _whole_words(words: tuple[str, ...]) -> re.Pattern:
    return re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, words)) + r")(?!\w)")


_FOR = {k: _whole_words(ws) for k, ws in CONTEXT.items()}
_AGAINST = {k: _whole_words(ws) for k, ws in AGAINST.items()}


def _near(text: str, start: int, end: int) -> str:
    """What stands around a span, in lower case; a word that the reach cuts ends in a digit, so that its rest is no word."""
    low, high = start - REACH, end + REACH
    before = "0" if low > 0 and re.match(r"\w", text[low - 1]) else ""
    after = "0" if re.match(r"\w", text[high : high + 1]) else ""
    return f"{before}{text[max(0, low) : start]} {text[end:high]}{after}".lower()


def _score(kind: str, text: str, start: int, end: int, confirmed: bool) -> float:
    near = _near(text, start, end)
    return round(0.4 + 0.4 * confirmed + 0.2 * bool(_FOR[kind].search(near)) - 0.2 * bool(kind in _AGAINST and _AGAINST[kind].search(near)), 2)


def _added(text: str):
    """Proposals of the kinds that are not of the base: kind, start, end, confirmed by a checksum."""
    for a, b in _ibans(text):
        yield "iban", a, b, True
    for m in _SSN.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield "ssn", m.start(), m.end(), False
    for kind, rx in (("birth", _BIRTH), ("account", _ACCOUNT)):
        for m in rx.finditer(text):
            yield kind, m.start(), m.end(), False


def spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """``(kind, start, end, score)`` by kind as listed, then start; code points, end exclusive. Null and empty texts have none."""
    if not text:
        return []
    found = []
    if "@" in text:
        found += [("email", a, b, _score("email", text, a, b, True)) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", m.start(), m.end(), _score("ip", text, m.start(), m.end(), False)))
    for m in _CARD.finditer(text):
        digits = m[0].translate(_ODD)
        if len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end(), _score("card", text, m.start(), m.end(), True)))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append(("phone", m.start(), m.end(), _score("phone", text, m.start(), m.end(), False)))
    for kind, a, b, sure in _added(text):
        if (score := _score(kind, text, a, b, sure)) >= ADDED_SCORE:
            found.append((kind, a, b, score))
    return found


def redacted(text: str | None) -> str | None:
    """The text with each span replaced by its kind in angle brackets; of spans that meet, the first stays."""
    found = sorted(spans(text), key=lambda s: (s[1], -s[2]))
    if not found:
        return text
    out, done = [], 0
    for kind, a, b, _ in found:
        if a < done:
            done = max(done, b)  # the rest of an overlapping span goes as well
            continue
        out += [text[done:a], f"<{kind.upper()}>"]
        done = b
    return "".join([*out, text[done:]])


def _span_lists(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in spans(t)])


def _redacted(text: pd.Series) -> pd.Series:
    return text.map(redacted)


def _digests(text: pd.Series) -> pd.DataFrame:
    rows = []
    for t in text:
        found = spans(t)
        n = [sum(s[0] == k for s in found) for k in KINDS[:4]]
        each = [f"{k}:{a}:{b}" for k, a, b, _ in found]
        base = ",".join(each[: sum(n)])
        rows.append((*n, hashlib.sha256(base.encode()).hexdigest(), ",".join(each), ",".join(f"{s[3]:.1f}" for s in found), max((s[3] for s in found), default=None)))
    return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores", "max_score"])


def find_pii(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, spans`` with kind, start, end and score of each span; other columns are ignored.

    Null and empty texts have none. Long texts are searched whole, in time that grows with their length. Spans of
    different kinds may overlap and all stay; repeated rows stay.
    """
    return docs.select(F.col(doc_id).alias("doc_id"), pandas_udf(_span_lists, SPANS)(F.col(text).cast("string")).alias("spans"))


def redact(text: Column) -> Column:
    """The text with its personal data replaced by its kind; null and empty texts stay as they are. Of spans that overlap the first stands for all."""
    return pandas_udf(_redacted, "string")(text.cast("string"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole_text_batches(spark)
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", pandas_udf(_digests, DIGEST)(F.col("text")).alias("r")).select("doc_id", "r.*")


def _sql() -> str:
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len([p FOR p IN string_split(x, '.') IF length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(ltrim(p, '0') AS INT), 0) > 255]) = 0"),
        "card": (r"[0-9](?:[ -]?[0-9])+", "length(dg) BETWEEN 16 AND 19 AND list_sum([CASE WHEN i % 2 = 1 THEN substr(rv, i, 1)::INT ELSE (substr(rv, i, 1)::INT * 2 - CASE WHEN substr(rv, i, 1)::INT > 4 THEN 9 ELSE 0 END) END FOR i IN generate_series(1, length(rv))]) % 10 = 0"),
        "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "length(dg) BETWEEN 8 AND 15"),
        "iban": (
            r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b",
            "list_reduce([c::INT FOR c IN string_split(array_to_string([CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE (ascii(c) - 55)::VARCHAR END FOR c IN string_split(substr(replace(x, ' ', ''), 5) || substr(replace(x, ' ', ''), 1, 4), '')], ''), '')], lambda a, b: (a * 10 + b) % 97) = 1",
        ),
    }
    kinds["ssn"] = (r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "substr(x, 1, 3) NOT IN ('000', '666') AND substr(x, 1, 1) <> '9' AND substr(x, 5, 2) <> '00' AND substr(x, 8) <> '0000'")
    kinds["birth"] = (r"\b(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/(?:19|20)[0-9]{2})\b", "true")
    kinds["account"] = (r"\b[0-9]{8,12}\b", "true")
    sure = {"email": 1, "ip": 0, "card": 1, "phone": 0, "iban": 1, "ssn": 0, "birth": 0, "account": 0}
    parts = []
    for k, (kind, (rx, test)) in enumerate(kinds.items()):
        says = lambda words: rf"regexp_matches(nr, '(^|[^\pL\pN_])({'|'.join(words)})($|[^\pL\pN_])')" if words else "false"
        near, against = says(CONTEXT[kind]), says(AGAINST.get(kind))
        parts.append(
            f"""SELECT rid, {k} AS k, '{kind}' AS kind, a, a + length(x) AS b, round(0.4 + 0.4 * {sure[kind]} + CASE WHEN {near} THEN 0.2 ELSE 0 END - CASE WHEN {against} THEN 0.2 ELSE 0 END, 2) AS score FROM
      (SELECT rid, x, a, regexp_replace(x, '[^0-9]', '', 'g') AS dg, reverse(regexp_replace(x, '[^0-9]', '', 'g')) AS rv,
              lower(CASE WHEN a > {REACH} AND regexp_matches(substr(t, a - {REACH}, 1), '[\\pL\\pN_]') THEN '0' ELSE '' END || substr(t, greatest(1, a - {REACH - 1}), a - greatest(1, a - {REACH - 1}) + 1) || ' ' || substr(t, a + length(x) + 1, {REACH})
                || CASE WHEN regexp_matches(substr(t, a + length(x) + {REACH + 1}, 1), '[\\pL\\pN_]') THEN '0' ELSE '' END) AS nr FROM
       (SELECT rid, t, m[i] AS x, (list_sum([length(y) FOR y IN p[1:i]]) + coalesce(list_sum([length(y) FOR y IN m[1:i - 1]]), 0))::BIGINT AS a FROM
        (SELECT rid, t, m, p, unnest(generate_series(1, len(m))) AS i FROM (SELECT rid, t, regexp_extract_all(t, '{rx}') AS m, string_split_regex(t, '{rx}') AS p FROM d WHERE regexp_matches(t, '{rx}'))))) WHERE {test}"""
        )
    counts = ", ".join(f"count(*) FILTER (s.k = {k})::BIGINT AS n_{kind}" for k, kind in enumerate(KINDS[:4]))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT * FROM ({" UNION ALL ".join(parts)}) WHERE k < 4 OR score >= {ADDED_SCORE})
SELECT d.doc_id, {counts}, sha256(coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY k, a) FILTER (k < 4), '')) AS base_sha256,
       coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY k, a), '') AS spans,
       coalesce(string_agg(printf('%.1f', score::DOUBLE), ',' ORDER BY k, a), '') AS scores, max(score)::DOUBLE AS max_score
FROM d LEFT JOIN s USING (rid) GROUP BY d.rid, d.doc_id
"""


SQL = _sql()
