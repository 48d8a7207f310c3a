"""Spelling variants: a symmetric-delete join finds the words at distance one, frequent forms take in rare ones.

Every word emits the key of itself and of each distinct single deletion. Two words are at distance one exactly if they
meet under a key and either one of them is the key itself (a letter more or less), or both lost a letter at a place
that can be the same (a letter replaced). A place is a run of equal letters, since each of them gives the same
deletion: the places are the same if the runs overlap. Keys are 64-bit hashes that come from running sums, so that a
word of L letters costs L steps, and rows of the join have the same few bytes however long the words are. What the join
lets through is verified on the words themselves.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawlake.llm.common import documents, frame, materialize, whole, whole_text_batches

RUN = "[A-Za-zÀ-ÿ]+"
#: Words counted in a task before it passes its counts on; letters of equally long words hashed at a time.
FLUSH, CELLS = 200_000, 1_000_000
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def damaged_words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", one_in: int = 31, min_length: int = 7) -> DataFrame:
    """``word, n`` from the letter runs of whole texts: of one run in ``one_in`` (by the CRC of ``doc_id:run``) a letter is lost.

    Only A to Z are lower-cased. Null and empty texts have no runs; a null id is the empty string; repeated rows count as
    often as they are there. Words shorter than ``min_length`` code points are left out; an empty table gives no rows.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs, counts = re.compile(RUN), Counter()
        for b in batches:
            for i, t in zip(b["id"], b["text"], strict=True):
                for run, n in Counter(runs.findall(t)).items():
                    if len(run) < min_length:
                        continue
                    word = run.lower() if run.isascii() else run.translate(_LOWER)
                    h = zlib.crc32(f"{i}:{word}".encode())
                    if h % one_in == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    counts[word] += n
                if len(counts) > FLUSH:
                    yield frame(counts.items(), ["word", "n"])
                    counts.clear()
        yield frame(counts.items(), ["word", "n"])

    whole_text_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), whole(F.col(text)).alias("text"))
    counted = rows.mapInPandas(count, "word string, n long").where(F.length("word") >= min_length)
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _hashed(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of one length, a row of code points each -> the hash of each word, and of every distinct deletion: its word's row, hash, first and last place."""
    m, length = codes.shape
    f = codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        f = (f ^ (f >> np.uint64(shift))) * np.uint64(factor)
    f ^= f >> np.uint64(31)
    power = np.cumprod(np.full(length, 0xD6E8FEB86659FD93, dtype=np.uint64))
    kept = np.cumsum(f * power, axis=1)
    moved = np.zeros_like(f)
    np.cumsum(f[:, 1:] * power[:-1], axis=1, out=moved[:, 1:])
    # Without letter i: the letters before it as they are, those behind it one place down.
    without = kept - f * power + moved[:, -1:] - moved
    first = np.ones(codes.shape, dtype=bool)
    first[:, 1:] = codes[:, 1:] != codes[:, :-1]
    at = np.flatnonzero(first)
    end = np.append(at[1:], m * length) - 1
    return kept[:, -1].view(np.int64), at // length, without.ravel()[at].view(np.int64), at % length, end % length


def _ids(words: pd.Series) -> pd.Series:
    out = np.zeros(len(words), dtype=np.int64)
    for at, codes in _by_length(words):
        out[at] = _hashed(codes)[0]
    return pd.Series(out)


def _by_length(words: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and code points of equally long words, a bounded number of letters at a time."""
    lengths = words.str.len().to_numpy()
    for length in np.unique(lengths):
        positions, step = np.flatnonzero(lengths == length), max(1, CELLS // max(int(length), 1))
        for k in range(0, len(positions), step):
            at = positions[k : k + step]
            yield at, np.frombuffer("".join(words.iloc[at]).encode("utf-32-le"), dtype="<u4").reshape(len(at), int(length))


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for _, codes in _by_length(b["word"]):
            own, row, key, first, last = _hashed(codes)
            yield pd.DataFrame({"key": own, "id": own, "first": np.int32(-1), "last": np.int32(-1)})
            yield pd.DataFrame({"key": key, "id": own[row], "first": first.astype(np.int32), "last": last.astype(np.int32)})


def near_words(words: DataFrame) -> DataFrame:
    """Distinct non-empty ``word, id, n`` -> ``word, n, near, near_n``: both directions of every two words at distance one."""
    keys = materialize(words.select("word").mapInPandas(_keys, "key long, id long, first int, last int"), "word-keys")
    a, b = keys.alias("a"), keys.alias("b")
    replaced = F.expr("a.first >= 0 AND b.first >= 0 AND a.first <= b.last AND b.first <= a.last")
    one_more = F.expr("(a.first < 0) <> (b.first < 0)")
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & (replaced | one_more)).select(F.col("a.id").alias("id"), F.col("b.id").alias("other"))
    pairs = pairs.join(words, "id").select("other", "word", "n")
    pairs = pairs.join(words.select(F.col("id").alias("other"), F.col("word").alias("near"), F.col("n").alias("near_n")), "other")
    pairs = pairs.where(F.levenshtein("word", "near", 1) == 1)
    both = F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return pairs.select(F.explode(both).alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """``word, form`` (each word once, no cycles) -> ``word, root``: the last form, by joins that double the length of the way."""
    up = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        over = up.select(F.col("word").alias("root"), F.col("root").alias("top"))
        if up.join(over, "root", "left_semi").isEmpty():
            return up
        up = materialize(up.join(over, "root", "left").select("word", F.coalesce("top", "root").alias("root")), "roots")


def variants(counts: DataFrame, min_length: int = 7, min_count: int = 2, ratio: int = 10) -> DataFrame:
    """``word, n`` -> ``word, form, root, n, n_near, form_n`` for the words of ``min_length`` code points and ``min_count`` occurrences.

    A word's form is its near word (one letter inserted, deleted or replaced) of largest n, ties the smallest in
    code-point order, if that n is at least ``ratio`` times its own; the root is the last form of the chain, the word
    itself without one. Rows of the same word are added up first; null words and counts are left out; no rows in, no rows out.
    Counts grow along the forms, so chains end after as many steps as the largest count has digits (for a ratio of ten).
    """
    if min_length < 1 or ratio < 2:
        raise ValueError("words need a letter, and forms must be more frequent than their variants")
    spark = counts.sparkSession
    words = counts.where(F.length("word") >= min_length).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    words = materialize(words.select("word", F.pandas_udf(_ids, "long")("word").alias("id"), "n"), "words")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"), F.max("n").alias("own"))
    enough = -F.col("best.less") >= F.col("own") * ratio
    near = near.select("word", "n_near", F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))
    near = materialize(near, "near-words")
    ends = roots(near.where("form IS NOT NULL").select("word", "form"))
    out = words.drop("id").join(near.join(ends, "word", "left"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants among the words of all documents, some of which lose a letter first."""
    return variants(damaged_words(documents(spark, sf_dir)))


#: CRC-32 of a text column ``x`` in SQL, bytewise over a table that comes from its polynomial.
CRC_TABLE = """bits(i, k, v) AS (SELECT i, 0, i::BIGINT FROM range(256) r(i) UNION ALL
  SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8)"""
CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex({x}), '..'), lambda b: ('0x' || b)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"

SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT i, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS c
         FROM (SELECT coalesce(doc_id::VARCHAR, '') AS i, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS r FROM documents) GROUP BY ALL),
hashed AS (SELECT w, c, {CRC.format(x="i || ':' || w")} AS h FROM runs, crc),
lost AS (SELECT CASE WHEN h % 31 = 0 THEN substring(w, 1, (h % length(w))::INT) || substring(w, (h % length(w))::INT + 2) ELSE w END AS word, c FROM hashed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM lost WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
keys AS (SELECT DISTINCT word, n, unnest(list_prepend(word, list_transform(range(1, length(word) + 1), lambda k: substring(word, 1, k::INT - 1) || substring(word, k::INT + 1)))) AS key FROM words),
pairs AS (SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM keys a JOIN keys b ON a.key = b.key AND a.word <> b.word
          WHERE abs(length(a.word) - length(b.word)) = 1
             OR length(a.word) = length(b.word) AND len(list_filter(range(1, length(a.word) + 1), lambda k: a.word[k] <> b.word[k])) = 1),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM pairs GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near,
            CASE WHEN b.top >= 10 * w.n THEN b.top END AS form_n,
            CASE WHEN b.top >= 10 * w.n THEN (SELECT min(p.near) FROM pairs p WHERE p.word = w.word AND p.near_n = b.top) END AS form
          FROM words w LEFT JOIN best b ON b.word = w.word),
up(word, root, step) AS (SELECT word, form, 1 FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT up.word, f.form, step + 1 FROM up JOIN forms f ON f.word = up.root WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(root, step) AS root FROM up GROUP BY word)
SELECT f.word, f.form, coalesce(e.root, f.word) AS root, f.n, f.n_near::BIGINT AS n_near, f.form_n FROM forms f LEFT JOIN ends e ON e.word = f.word
"""
