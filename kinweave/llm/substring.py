"""Substring dedup over words by difference-cover anchors.

A window is ``window`` consecutive words. Positions whose residue modulo ``period`` lies in a difference
cover carry an anchor, the hash of ``window - period + 1`` words: for any two positions there is a shift below
the period that brings both onto cover positions, so two equal windows always share an aligned anchor. Anchors
found in different word sequences go into a bit filter of fixed size; texts without any are done in that pass. An
anchor of the filter extends to the windows that hold it, and these are compared in whole, by 128-bit hash, against
all others. Copies of a whole word sequence meet by its 128-bit digest; a task takes windows of a copy only where no
copy of smaller id came before in it.

Null text: no words. Null id: after every other id; two rows with one id never remove from each other. Texts
under a window stay whole. An empty table gives an empty result. Extra columns come back in ``rest``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

WINDOW, PERIOD = 50, 31
_R1, _R2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_COPY = np.uint64(0x5851F42D4C957F2D)


def difference_cover(period: int) -> tuple[int, ...]:
    """The first smallest set of residues, 0 among them, whose differences reach every residue."""
    size = 1
    while True:
        if size * (size - 1) + 1 >= period:
            for rest in combinations(range(1, period), size - 1):
                cover = (0, *rest)
                if len({(a - b) % period for a in cover for b in cover}) == period:
                    return cover
        size += 1


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def anchor_hash(h: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(length):
            out = out * _R1 + h[at + j]
    return C.mix64(out)


def window_hashes(h: np.ndarray, length: int, r: np.uint64) -> np.ndarray:
    """A hash of the ``length`` words at each position, by doubling."""
    n = 1
    with np.errstate(over="ignore"):
        while n < length:
            more = min(n, length - n)
            h = C.mix64(h[: len(h) - more] * r + h[more:])
            n += more
    return h


class _Scan:
    """Anchors and windows of the texts of a batch."""

    def __init__(self, window: int, period: int):
        assert 0 < period <= window
        self.window, self.period, self.anchor = window, period, window - period + 1
        self.cover = np.zeros(period, bool)
        self.cover[list(difference_cover(period))] = True

    def anchors(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, position, key) of the anchors of texts of a window or more."""
        size = np.array([len(t) for t in texts], np.int64)
        size[size < self.window] = 0
        h = word_hashes([w for t, n in zip(texts, size, strict=True) if n for w in t])
        ends = np.cumsum(size)
        row = np.repeat(np.arange(len(texts)), size)
        pos = np.arange(len(h)) - (ends - size)[row]
        at = np.flatnonzero(self.cover[pos % self.period] & (pos + self.anchor <= size[row]))
        return row[at], pos[at], anchor_hash(h, at, self.anchor)

    def ranges(self, n: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[start, end) of the starts of windows that hold an anchor at one of the ascending positions, of a text of n words."""
        lo, hi = np.maximum(at - self.period + 1, 0), np.minimum(at + 1, n - self.window + 1)
        lo, hi = lo[lo < hi], hi[lo < hi]
        new = lo[1:] > hi[:-1]
        return lo[np.r_[True, new][: len(lo)]], hi[np.r_[new, True][: len(hi)]]


def _sequences(texts: list[list[bytes]]) -> np.ndarray:
    """(n, 2): 128-bit digests of word sequences."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(b" ".join(w)) for w in texts]), np.uint64).reshape(-1, 2)


Emit = Callable[[pa.RecordBatch, list[bytes], list[list[dict[str, int]]]], pa.RecordBatch]


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, period: int = PERIOD, filter_bits: int = C.FILTER_BITS, emit: Emit | None = None, fields: str | T.StructType | None = None) -> DataFrame:
    """(did, text, rest, spans): spans are [start, end) word ranges, sorted and disjoint, that repeat a document of smaller id.

    ``emit`` makes other columns (``fields``) of a batch (did, text, rest), its texts and their spans, in the same pass.
    """
    spark: SparkSession = docs.sparkSession
    rows, scan = C.keyed(docs, id_col, text_col), _Scan(window, period)
    rest = rows.schema["rest"].dataType
    if emit is None:
        fields = C.fields("did long, text string", ("rest", rest), "spans array<struct<start:int,end:int>>")

        def emit(b: pa.RecordBatch, texts: list[bytes], spans: list[list[dict[str, int]]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*b.columns, pa.array(spans, _SPANS)], names=[*b.schema.names, "spans"])

    fields = T.StructType.fromDDL(fields) if isinstance(fields, str) else fields

    def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.split() for t in C.texts_of(b, "text")]
            seq = _sequences(texts)[:, 0]
            row, _, key = scan.anchors(texts)
            whole = np.flatnonzero([len(t) >= window for t in texts])
            keys = np.concatenate([key, seq[whole] ^ _COPY])
            tags = np.concatenate([seq[row], b.column(0).to_numpy()[whole].view(np.uint64)])
            yield pa.RecordBatch.from_arrays([C.signed(keys), C.signed(tags)], ["key", "tag"])

    anchors = C.mapped(rows.select("did", "text"), anchor_rows, "key long, tag long")
    hot = anchors.groupBy("key").agg(F.min("tag").alias("lo"), F.max("tag").alias("hi")).where("lo <> hi").select("key")
    bitmap = spark.sparkContext.broadcast(C.bit_filter(hot, "key", filter_bits))

    def sort_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts without an anchor of the filter are done (``out``); of the others the windows' starts are kept as ranges."""
        base = TaskContext.get().partitionId() << 40
        for b in batches:
            raw = list(C.texts_of(b, "text"))
            texts = [t.split() for t in raw]
            seq = _sequences(texts)
            row, pos, key = scan.anchors(texts)
            k = C.in_filter(bitmap.value, key)
            row, pos = row[k], pos[k]
            flag = C.in_filter(bitmap.value, seq[:, 0] ^ _COPY) & np.array([len(t) >= window for t in texts])
            flag[row] = True
            clean, hit = np.flatnonzero(~flag), np.flatnonzero(flag)
            cut = np.searchsorted(row, [*hit, len(texts)])
            found = [scan.ranges(len(texts[i]), pos[a:z]) for i, a, z in zip(hit.tolist(), cut[:-1], cut[1:], strict=True)]
            done = emit(b.take(pa.array(clean)), [raw[i] for i in clean], [[] for _ in clean])
            done = pa.StructArray.from_arrays(done.columns, names=done.schema.names)
            none = np.zeros(0, np.int64)
            ranges = pa.StructArray.from_arrays([pa.array(np.concatenate([none, *[x[i] for x in found]]).astype(np.int32)) for i in (0, 1)], names=["start", "end"])
            ends = np.cumsum([0, *[len(x) for x, _ in found]])
            own = [pa.array(base + np.arange(len(hit))), C.signed(seq[hit, 0]), C.signed(seq[hit, 1]), *b.take(pa.array(hit)).columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ranges), pa.nulls(len(hit), done.type)]
            names = ["u", "s1", "s2", *b.schema.names, "ranges", "out"]
            base += len(hit)
            yield pa.RecordBatch.from_arrays(own, names)
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(clean), x.type) for x in own[:-1]], done], names)

    kinds = C.fields("u long, s1 long, s2 long, did long, text string", ("rest", rest), "ranges array<struct<start:int,end:int>>", ("out", fields))
    sorted_out = C.stored(C.mapped(rows, sort_out, kinds), "repeats")
    hits = sorted_out.where("u is not null")

    def window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[tuple[int, int], int] = {}  # the smallest id that the task met of each word sequence
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(4)] + [b.column(5).to_pylist()]
            for u, did, s1, s2, ranges, text in zip(*cols, C.texts_of(b, "text"), strict=True):
                if least.setdefault((s1, s2), did) < did:
                    continue
                least[s1, s2] = did
                words = text.split()
                for r in ranges:
                    for start in range(r["start"], r["end"], 50_000):
                        at = np.arange(start, min(r["end"], start + 50_000), dtype=np.int32)
                        h = word_hashes(words[start : start + len(at) + window - 1])
                        w1, w2 = window_hashes(h, window, _R1), window_hashes(C.mix64(h), window, _R2)
                        yield pa.RecordBatch.from_arrays([C.signed(w1), C.signed(w2), pa.array(np.full(len(at), did)), pa.array(np.full(len(at), u)), pa.array(at)], ["w1", "w2", "did", "u", "at"])

    windows = C.mapped(hits.select("u", "did", "s1", "s2", "text", "ranges"), window_rows, "w1 long, w2 long, did long, u long, at int")
    first = windows.groupBy("w1", "w2").agg(F.min("did").alias("first"), F.max("did").alias("last")).where("first < last").drop("last")
    # stored, so that the join deals both sides anew and Spark can split a window that very many documents hold
    first = C.stored(first, "repeated-windows")
    late = windows.join(first, ["w1", "w2"]).where("did > first").groupBy("u").agg(F.collect_set("at").alias("at"))
    copies = hits.groupBy("s1", "s2").agg(F.min("did").alias("first"), F.max("did").alias("last"), F.count("*").alias("n")).where("first < last").drop("last")
    copies = C.stored(copies, "repeated-texts")
    whole = C.joined(hits.select("u", "did", "s1", "s2"), copies, ["s1", "s2"], "n").where("did > first").select("u", F.lit(True).alias("whole"))
    # both sides are at most the rows of `hits`
    found = whole.join(late, "u", "full")

    def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, out = list(C.texts_of(b, "text")), []
            for text, at, all_of in zip(texts, b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                if all_of:
                    out.append([{"start": 0, "end": len(text.split())}])
                else:
                    out.append(merge_spans(np.sort(np.array(at, np.int64)), window) if at else [])
            yield emit(b.select([0, 1, 2]), texts, out)

    resolved = hits.select("u", "did", "text", "rest").join(found, "u", "left").select("did", "text", "rest", "at", "whole")
    return sorted_out.where("u is null").select("out.*").unionByName(C.stored(C.mapped(resolved, repeats, fields), "repeats-cut"))


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def merge_spans(starts: np.ndarray, length: int) -> list[dict[str, int]]:
    """Runs covered by [s, s + length) of sorted starts."""
    cut = np.flatnonzero(np.diff(starts) > length)
    lo, hi = starts[np.r_[0, cut + 1]], starts[np.r_[cut, len(starts) - 1]] + length
    return [{"start": int(a), "end": int(b)} for a, b in zip(lo, hi, strict=True)]


def kept_words(text: bytes, spans: list[dict[str, int]]) -> tuple[list[bytes], int]:
    words, out, at = text.split(), [], 0
    for s in spans:
        out += words[at : s["start"]]
        at = s["end"]
    return (out + words[at:] if spans else words), len(words)


def digests(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) from the spans of :func:`find_repeats`."""

    def emit(b: pa.RecordBatch, texts: list[bytes], spans: list[list[dict[str, int]]]) -> pa.RecordBatch:
        n, gone, sha = [], [], []
        for text, own in zip(texts, spans, strict=True):
            kept, total = kept_words(text, own)
            n.append(total)
            gone.append(total - len(kept))
            sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["did", "n_words", "n_removed", "kept_sha256"])

    out = find_repeats(docs, emit=emit, fields="did long, n_words long, n_removed long, kept_sha256 string", **how)
    return out.select(C.plain_id().alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with repeated words cut out (kept words joined by one space); documents of which nothing is left go."""

    def emit(b: pa.RecordBatch, texts: list[bytes], spans: list[list[dict[str, int]]]) -> pa.RecordBatch:
        kept = [(b" ".join(kept_words(t, s)[0]) if s else t).decode() for t, s in zip(texts, spans, strict=True)]
        left = pa.array([bool(k) or not s for k, s in zip(kept, spans, strict=True)], pa.bool_())
        return pa.RecordBatch.from_arrays([b.column(2), pa.array(kept, pa.string())], ["rest", "kept"]).filter(left)

    rest = C.keyed(docs, id_col, text_col).schema["rest"].dataType
    out = find_repeats(docs, id_col, text_col, emit=emit, fields=C.fields(("rest", rest), "kept string"), **how)
    return out.select(*[F.col("kept").alias(text_col) if c == text_col else F.col("rest")[c].alias(c) for c in docs.columns])


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(C.table(spark, sf_dir, "documents"))


#: The same rows in SQL: every window of every text, by hash.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)
), first AS (
  SELECT h, min(doc_id) AS first FROM win GROUP BY h
), gone AS (
  SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, i FROM win JOIN first USING (h) WHERE first < doc_id), range(0, 50) t(k)
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) x ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
