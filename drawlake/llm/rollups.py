"""Token counts: delta-maintained rollups with idempotent batch commits.

A batch holds signed rows: inserts count +1 document and +tokens, deletes -1 and -tokens, and a revised count is
a delete of the old row and an insert of the new one. Rows are summed to a delta per (source, lang, tokenizer)
before they are written, so totals are sums of small tables. Every try of a batch writes a folder of its own; the
batch's marker, which is renamed into place without overwriting, names the folder that counts. Of two drivers with the same batch
one makes the marker and the other's folder is never read. Old batches are folded into a base total.
"""

from __future__ import annotations

import base64
import re
import uuid
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from drawlake.llm.common import documents, materialize, run_dir, whole, whole_text_batches, word_count

KEYS = ("source", "lang", "tokenizer")
TOKENIZER_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public pre-tokenisation pattern of byte-level BPE vocabularies of 50k.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table_, special_tokens={})


def token_count(spark: SparkSession, text: Column, path: str = TOKENIZER_FILE, pattern: str = PATTERN) -> Column:
    """Tokens of a whole text, however long, under a byte-level BPE vocabulary; 0 for null and empty texts. The file is read by the driver."""
    with open(path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())  # a vocabulary: under 1 MB whatever the data

    def count(texts: pd.Series) -> pd.Series:
        encode = _encoding(ranks.value, pattern).encode_ordinary
        return texts.map(lambda t: len(encode(t)))

    return pandas_udf(count, "long")(whole(text))


def deltas(inserts: DataFrame | None = None, deletes: DataFrame | None = None) -> DataFrame:
    """Rows of ``source, lang, tokenizer, tokens`` -> signed sums ``n_docs, n_tokens`` per key.

    Null tokens count 0, null keys are keys, repeated rows count as often as they are there; empty tables give no rows.
    """
    if inserts is None and deletes is None:
        raise ValueError("a batch needs inserts or deletes")
    signed = [d.select(*KEYS, F.lit(s).cast("long").alias("n_docs"), (F.coalesce("tokens", F.lit(0)) * s).cast("long").alias("n_tokens")) for d, s in ((inserts, 1), (deletes, -1)) if d is not None]
    both = signed[0] if len(signed) == 1 else signed[0].unionByName(signed[1])
    return both.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class TokenRollup:
    """Additive totals in a folder that all machines share.

    ``batches/<id>/<try>`` holds deltas, ``commits/<id>`` the name of the try that counts, ``bases/<n>`` that of a folder
    with the totals (``totals``) and the ids (``ids``) of the batches folded into it. Markers are renamed into place,
    never onto another one, which the shared file system must do in one step (the local one looks first).
    """

    SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, where: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(where)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _names(self, where: str) -> list[str]:
        fs, at = self._fs(f"{self.path}/{where}")
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _read(self, where: str) -> str | None:
        """A marker's content; None where there is none or it is torn."""
        fs, at = self._fs(f"{self.path}/{where}")
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8") or None
        finally:
            stream.close()

    def _mark(self, where: str, content: str) -> bool:
        """Make a marker; False if there is one with content already. It is written under a name of its own and renamed without overwriting, so that a marker is whole from the moment it is there."""
        if self._read(where) is not None:
            return False
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        fs, own = self._fs(f"{self.path}/marks/{uuid.uuid4().hex}")
        out = fs.create(own, False)
        out.write(bytearray(content.encode()))
        out.close()
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{where}")
        fs.mkdirs(at.getParent())
        if fs.exists(at):  # without content: none of ours, which are whole when they appear
            fs.delete(at, False)
        no_overwrite = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(own), fs.makeQualified(at), no_overwrite)
        except Exception:
            fs.delete(own, False)
            if self._read(where) is None:  # no other driver was first: the file system failed
                raise
            return False
        return True

    def committed(self, batch: str) -> bool:
        return self._read(f"commits/{batch}") is not None

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of deltas; False, and no change, if this batch id was committed before or another driver was first."""
        if not re.fullmatch(r"[A-Za-z0-9_-]+", batch):
            raise ValueError(f"not a batch id: {batch!r}")
        if self.committed(batch):
            return False
        cols = [c.strip().split(" ") for c in self.SCHEMA.split(",")]
        own = uuid.uuid4().hex
        changes.select(*[F.col(n).cast(t) for n, t in cols]).write.parquet(f"{self.path}/batches/{batch}/{own}")
        return self._mark(f"commits/{batch}", own)

    def _state(self) -> tuple[list[str], list[str], list[str]]:
        """Folders to add up, the ids they hold of batches that are in no base, and all ids; names only, one a batch."""
        paths, folded = [], set()
        bases = [b for b in self._names("bases") if self._read(f"bases/{b}")]
        if bases:
            base = f"{self.path}/folded/{self._read(f'bases/{bases[-1]}')}"
            paths.append(f"{base}/totals")
            folded = {r["id"] for r in self.spark.read.schema("id string").parquet(f"{base}/ids").collect()}
        new = {i: own for i in self._names("commits") if i not in folded and (own := self._read(f"commits/{i}"))}
        return paths + [f"{self.path}/batches/{i}/{own}" for i, own in new.items()], sorted(new), sorted(folded | set(new))

    def _sum(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.SCHEMA)
        rows = self.spark.read.schema(self.SCHEMA).parquet(*paths)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, n_docs, n_tokens`` over the committed batches; no rows before the first."""
        return self._sum(self._state()[0])

    def compact(self) -> bool:
        """Fold the committed batches into a new base, so that totals read one table; False if there is nothing new or another driver was first."""
        paths, new, every = self._state()
        if not new:
            return False
        own = uuid.uuid4().hex
        # The folders that go with these ids, whatever was committed since.
        self._sum(paths).write.parquet(f"{self.path}/folded/{own}/totals")
        self.spark.createDataFrame([(i,) for i in every], "id string").write.parquet(f"{self.path}/folded/{own}/ids")
        return self._mark(f"bases/{len(every):012d}", own)


def versions(counts: DataFrame, tokenizers: dict[str, str]) -> DataFrame:
    """One row per document and tokenizer version from a table with a count column for each."""
    pairs = F.array(*[F.struct(F.lit(name).alias("tokenizer"), F.col(c).alias("tokens")) for name, c in tokenizers.items()])
    return counts.select("source", "lang", F.explode(pairs).alias("v")).select("source", "lang", "v.*")


def op8_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under a word count and a byte-level BPE, each text once (that of the smallest doc_id, nulls last, then source and lang).

    Batches: ``load`` inserts word counts, and a quarter of the characters as a first guess of the BPE's; ``revise``
    deletes every guess and inserts the count of the tokenizer; ``dedup`` deletes all rows of a text that repeats, whatever
    their ids, and inserts one. ``load`` is sent twice and counts once; what was committed by then is folded into a base.
    A null text is an empty one with 0 tokens, null sources and languages are keys of their own, repeated rows are repeats of a
    text; an empty table gives no rows.
    """
    whole_text_batches(spark)
    docs = documents(spark, sf_dir)
    text = F.col("text")
    counts = docs.select("doc_id", "source", "lang", F.sha2(whole(text), 256).alias("text_key"), word_count(text).alias("words"), F.ceil(F.length(whole(text)) / 4).alias("guess"), token_count(spark, text).alias("bpe"))
    counts = materialize(counts, "token-counts")
    # Texts that occur once need no join; written, so that the join can split the rows of a frequent text.
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "source", "lang")
    first = counts.groupBy("text_key").agg(F.min(order).alias("kept"), F.count("*").alias("n"), F.first("words").alias("words"), F.first("bpe").alias("bpe")).where("n > 1")
    first = materialize(first.select("text_key", "kept.source", "kept.lang", "words", "bpe"), "first-of-text")
    repeats = counts.join(first.select("text_key"), "text_key", "left_semi")
    roll = TokenRollup(spark, f"{run_dir(spark)}/rollup-{uuid.uuid4().hex}")
    load = deltas(inserts=versions(counts, {"words-1": "words", "byte-bpe-50k": "guess"}))
    both = {"words-1": "words", "byte-bpe-50k": "bpe"}
    roll.commit("load", load)
    roll.commit("revise", deltas(inserts=versions(counts, {"byte-bpe-50k": "bpe"}), deletes=versions(counts, {"byte-bpe-50k": "guess"})))
    roll.compact()
    roll.commit("dedup", deltas(inserts=versions(first, both), deletes=versions(repeats, both)))
    roll.commit("load", load)
    return roll.totals()
