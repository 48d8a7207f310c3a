"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The automaton reports, at each position, every piece that ends there (its output links); each relaxes the best
score of that position. Where no piece spans two neighbouring characters (a letter and the blank or the comma after
it) the best path of a text is that of its chunks, and the path of a chunk is kept and used again. Characters without a
piece become their UTF-8 bytes. Decoding an encoding gives the text back exactly.
"""

from __future__ import annotations

import math
import re
import string
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from drawlake.llm.common import documents, whole_text_batches

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Chunks whose path a worker keeps in each of two generations, and their length at most.
KEPT_CHUNKS, KEPT_LENGTH = 100_000, 48
#: What an unknown character costs beyond the worst piece.
UNKNOWN_PENALTY = 10.0


def load_pieces(path: str = MODEL_FILE) -> list[tuple[str, float, int]]:
    """``(piece, score, kind)`` by id; kind 0 is an ordinary piece, 1 a byte, 2 anything that text never gives.

    A unigram model's scores are log-probabilities and are taken as they are. A BPE model's scores are merge ranks
    (whole numbers that fall by one); they are taken as the log-probabilities of a Zipf law over those ranks.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.piece_size()
    kinds = [1 if sp.is_byte(i) else 2 if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else 0 for i in range(n)]
    scores = [sp.get_score(i) for i in range(n)]
    if all(s == int(s) and s <= 0 for s, k in zip(scores, kinds, strict=True) if k == 0):
        total = math.log(sum(1 / (1 - s) for s, k in zip(scores, kinds, strict=True) if k == 0))
        scores = [-math.log(1 - s) - total if k == 0 else s for s, k in zip(scores, kinds, strict=True)]
    return [(sp.id_to_piece(i), scores[i], kinds[i]) for i in range(n)]


class PieceCodec:
    """Encoder and decoder over a list of pieces as ``load_pieces`` gives it."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.bytes = [0] * 256
        for i, (piece, score, kind) in enumerate(pieces):
            if kind == 0:
                self.automaton.add_word(piece, (i, len(piece), score))
            elif kind == 1:
                self.bytes[int(piece[3:5], 16)] = i
        self.automaton.make_automaton()
        plain = [p for p, _, k in pieces if k == 0]
        self.unknown = min(s for _, s, k in pieces if k == 0) - UNKNOWN_PENALTY
        if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in plain):
            raise ValueError("a piece holds a blank mark after another character")
        # A line feed that no piece holds is a chunk of its own.
        feed = "" if any("\n" in p for p in plain) else r"\n"
        # ASCII marks that no piece holds after an ASCII letter: a word of such letters may be cut before them.
        letters = set(string.ascii_letters)
        held = {b for p in plain for a, b in zip(p, p[1:]) if a in letters}
        marks = re.escape("".join(c for c in string.punctuation if c not in held))
        self.chunk = re.compile((rf" *[A-Za-z]++(?=[{marks}])|" if marks else "") + rf" *[^ {feed}]+|\n| +")
        self.single = {p for p in plain if len(p) == 1}
        self.surface = [p.replace(BLANK, " ") if k == 0 else "" for p, _, k in pieces]
        self.value = np.full(len(pieces), -1, dtype=np.int16)
        for b, i in enumerate(self.bytes):
            self.value[i] = b
            if b < 128:
                self.surface[i] = chr(b)
        self.kept: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def viterbi(self, marked: str) -> list[int]:
        """Best path over a string whose blanks are marks already; of equal ones, that with the longer last piece."""
        n = len(marked)
        best, back = [0.0] + [-math.inf] * n, [(-1, 1, 0.0)] * (n + 1)
        # A character that is a piece costs less so than as an unknown one: unknowns are tried only where it is none.
        odd = () if self.single.issuperset(marked) else [k for k, c in enumerate(marked, 1) if c not in self.single]
        waiting = iter(odd)
        gap = next(waiting, n + 1)
        for end, hit in self.automaton.iter(marked):  # by end, the longest first
            end += 1
            while gap < end:
                if best[gap - 1] + self.unknown > best[gap]:
                    best[gap], back[gap] = best[gap - 1] + self.unknown, (-1, 1, 0.0)
                gap = next(waiting, n + 1)
            s = best[end - hit[1]] + hit[2]
            if s > best[end]:
                best[end], back[end] = s, hit
        while gap <= n:
            if best[gap - 1] + self.unknown > best[gap]:
                best[gap], back[gap] = best[gap - 1] + self.unknown, (-1, 1, 0.0)
            gap = next(waiting, n + 1)
        out, at = [], n
        while at:
            i, length, _ = back[at]
            out += [i] if i >= 0 else [self.bytes[b] for b in reversed(marked[at - 1].encode())]
            at -= length
        return out[::-1]

    def _path(self, chunk: str) -> tuple[int, ...]:
        blanks = len(chunk) - len(chunk.lstrip(" "))
        marked = BLANK * blanks + chunk[blanks:]
        if BLANK not in chunk:
            return tuple(self.viterbi(marked))
        # The mark itself, where the text has it, is no blank: it goes by its bytes.
        own = [self.bytes[b] for b in BLANK.encode()]
        parts = [BLANK * blanks + p if k == 0 else p for k, p in enumerate(chunk[blanks:].split(BLANK))]
        return tuple(i for k, p in enumerate(parts) for i in [*(own if k else ()), *(self.viterbi(p) if p else ())])

    def encode(self, text: str | None) -> list[int] | None:
        """Ids of a whole text; null stays null, an empty text has none."""
        if text is None:
            return None
        out: list[int] = []
        if not text:
            return out
        kept = self.kept
        for chunk in self.chunk.findall(" " + text):
            path = kept.get(chunk)
            if path is None:
                path = self.older.get(chunk) or self._path(chunk)
                if len(chunk) <= KEPT_LENGTH:
                    if len(kept) >= KEPT_CHUNKS:
                        self.older, self.kept = kept, (kept := {})
                    kept[chunk] = path
            out += path
        return out

    def decode(self, ids: list[int] | np.ndarray | None) -> str | None:
        """The text of an encoding: bytes become characters again, the blank before the text goes."""
        if ids is None:
            return None
        if len(ids) == 0:
            return ""
        ids = np.asarray(ids)
        surface = self.surface
        if (self.value[ids] < 128).all():
            return "".join([surface[i] for i in ids.tolist()])[1:]
        out: list[str] = []
        run = bytearray()
        for i in ids.tolist():
            if self.value[i] >= 128:
                run.append(self.value[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            out.append(surface[i])
        return "".join([*out, run.decode("utf-8", "replace")])[1:]


@lru_cache(maxsize=2)
def _codec_of(key: int, holder) -> PieceCodec:
    return PieceCodec(holder.value)


def _shared(spark: SparkSession, path: str):
    # A vocabulary: under 2 MB whatever the data. The driver reads the file.
    return spark.sparkContext.broadcast(load_pieces(path))


def _codec(holder) -> PieceCodec:
    return _codec_of(id(holder), holder)


def encode(spark: SparkSession, text: Column, path: str = MODEL_FILE) -> Column:
    """Ids of each whole text (array of int)."""
    whole_text_batches(spark)
    holder = _shared(spark, path)

    def f(texts: pd.Series) -> pd.Series:
        return texts.map(_codec(holder).encode)

    return pandas_udf(f, "array<int>")(text.cast("string"))


def decode(spark: SparkSession, ids: Column, path: str = MODEL_FILE) -> Column:
    """Texts of arrays of ids; null stays null."""
    whole_text_batches(spark)
    holder = _shared(spark, path)

    def f(arrays: pd.Series) -> pd.Series:
        return arrays.map(_codec(holder).decode)

    return pandas_udf(f, "string")(ids)


def encode_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str = MODEL_FILE) -> DataFrame:
    """``doc_id, ids, n_pieces, n_bytes, decoded_ok``; other columns are ignored.

    ``decoded_ok`` says that decoding the ids gave the text back. A null text has null ids, 0 pieces, and is in order;
    an empty one has no ids. Texts are encoded whole, one word without blanks as well, in time that grows with their
    length. Repeated rows stay; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    whole_text_batches(spark)
    holder = _shared(spark, path)

    def f(texts: pd.Series) -> pd.DataFrame:
        codec = _codec(holder)
        rows = []
        for t in texts:
            ids = codec.encode(t)
            a = np.asarray(ids or [], dtype=np.int32)
            rows.append((None if ids is None else a, len(a), int((codec.value[a] >= 0).sum()), codec.decode(ids) == t))
        return pd.DataFrame(rows, columns=["ids", "n_pieces", "n_bytes", "decoded_ok"])

    r = pandas_udf(f, "struct<ids:array<int>,n_pieces:long,n_bytes:long,decoded_ok:boolean>")(F.col(text).cast("string"))
    return docs.select(F.col(doc_id).alias("doc_id"), r.alias("r")).select("doc_id", "r.*")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir))
