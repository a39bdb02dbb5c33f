"""Benchmark decontamination: a BM25 inverted index of test items, asked with every passage of every document.

Items are indexed in entries of at most ``HALF`` words; a posting's weight is its BM25 contribution over the
entry's own total, so a score is the share of an entry's weight that a passage holds. Passages are two adjacent
runs of ``HALF`` words, so each stretch of that length lies whole in one. Block-max WAND retrieves every entry at or
above the threshold: the block maxima of a passage's terms bound each block's scores, blocks under the threshold
are passed over, and in the others pivots skip entries that cannot reach it. A retrieved entry counts when word
trigrams of both its question (first two thirds) and its answer (the rest) overlap the passage.

Words are runs between white space and ASCII punctuation, in lower case. Null texts have none. Items of fewer than
``MIN_WORDS`` words cannot prove an overlap: they are found where a line of a document consists of just these words, in
order. Items without words match nothing; null and repeated item ids stay as they are, ids may be of any type.

The index is built by tasks and kept in files, each a shard of about ``SHARD_ITEMS`` entries. Documents are read once:
a task asks every shard about ``GROUP_BYTES`` of text at a time, and holds ``HELD`` shards at most. Very long texts are
asked by themselves. Rows of one id are told apart by ``seq``, a hash of the text.
"""

from __future__ import annotations

import pickle
import string
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common as C
from .files import published, reader

HALF, MIN_WORDS, BLOCK, SHARD_ITEMS = 64, 5, 4, 1024
THRESHOLD, OVERLAP, GRAM = 0.5, 0.5, 3
GROUP_BYTES, HELD = 4 << 20, 4
K1, B = 1.2, 0.75
_TO_SPACE = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_TO_SPACE).split()


@dataclass
class Entry:
    item: object
    words: list[bytes]


@dataclass
class Index:
    """One shard: entries, the ids of their words, postings by term and block, block maxima; and short items by their words."""

    entries: list[Entry]
    idf: dict[bytes, float]
    mean: float
    short: dict[bytes, list[object]] = field(default_factory=dict)
    ids: dict[bytes, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.blocks = -(-len(self.entries) // BLOCK)
        found: dict[int, list[tuple[int, float]]] = defaultdict(list)
        self.sequences = []
        for e, entry in enumerate(self.entries):
            tf = Counter(entry.words)
            norm = K1 * (1 - B + B * len(entry.words) / self.mean)
            weight = {w: self.idf[w] * n * (K1 + 1) / (n + norm) for w, n in tf.items()}
            total = sum(weight.values())
            for w, x in weight.items():
                found[self.ids.setdefault(w, len(self.ids))].append((e, x / total))
            self.sequences.append(np.array([self.ids[w] for w in entry.words], np.int64))
        self.top = np.zeros((len(self.ids), self.blocks), np.float32)
        self.postings: dict[tuple[int, int], list[tuple[int, float]]] = defaultdict(list)
        for t, list_of in found.items():
            for e, x in list_of:
                self.postings[t, e // BLOCK].append((e, x))
                self.top[t, e // BLOCK] = max(self.top[t, e // BLOCK], np.nextafter(np.float32(x), np.float32(2)))

    def __reduce__(self):
        return Index, (self.entries, self.idf, self.mean, self.short)

    def wand(self, terms: list[int], block: int, threshold: float) -> list[tuple[int, float]]:
        """Entries of a block with a score of at least the threshold, with it."""
        lists = [(self.postings[t, block], float(self.top[t, block])) for t in terms if (t, block) in self.postings]
        at = [0] * len(lists)
        order = list(range(len(lists)))
        out = []
        while True:
            order = [i for i in order if at[i] < len(lists[i][0])]
            order.sort(key=lambda i: lists[i][0][at[i]][0])
            bound, pivot = 0.0, None
            for i in order:
                bound += lists[i][1]
                if bound >= threshold:
                    pivot = lists[i][0][at[i]][0]
                    break
            if pivot is None:
                return out
            if lists[order[0]][0][at[order[0]]][0] == pivot:
                score = 0.0
                for i in order:
                    e, x = lists[i][0][at[i]]
                    if e == pivot:
                        score += x
                        at[i] += 1
                if score >= threshold:
                    out.append((pivot, score))
            else:
                for i in order:
                    while at[i] < len(lists[i][0]) and lists[i][0][at[i]][0] < pivot:
                        at[i] += 1

    def retrieve(self, seq: np.ndarray, threshold: float) -> Iterator[tuple[int, int, float]]:
        """(passage, entry, score) of all that reach the threshold; seq: term ids of a text's words, -1 for others."""
        known = np.flatnonzero(seq >= 0)
        if not len(known):
            return
        pair = np.unique((known // HALF) * len(self.ids) + seq[known])
        half, term = np.divmod(pair, len(self.ids))
        begin = np.flatnonzero(np.r_[True, half[1:] != half[:-1]])
        bound = np.zeros((len(seq) // HALF + 2, self.blocks), np.float32)
        bound[half[begin]] = np.add.reduceat(self.top[term], begin, axis=0)
        reach = bound[:-1] + bound[1:] >= threshold * (1 - 1e-5)  # a term in both halves counts twice: still a bound
        for p in np.flatnonzero(reach.any(axis=1)):
            terms = np.unique(term[(half == p) | (half == p + 1)])
            once = self.top[terms].sum(axis=0) >= threshold * (1 - 1e-5)
            for block in np.flatnonzero(reach[p] & once):
                for entry, score in self.wand(terms.tolist(), int(block), threshold):
                    yield int(p), entry, score

    def overlap(self, passage: np.ndarray, entry: int) -> tuple[float, float]:
        """Shares of the question's and the answer's word n-grams that stand in the passage."""
        seq = self.sequences[entry]
        cut = -(-2 * len(seq) // 3)
        out = []
        for part in (seq[:cut], seq[cut:]):
            n = min(GRAM, len(part))
            there = set(zip(*[passage[i : len(passage) - n + 1 + i].tolist() for i in range(n)], strict=True))
            own = list(zip(*[part[i : len(part) - n + 1 + i].tolist() for i in range(n)], strict=True))
            out.append(sum(g in there for g in own) / len(own))
        return out[0], out[1]

    def search(self, text: str | None, words: list[bytes], threshold: float, overlap: float) -> dict[object, tuple[float, float, float, int]]:
        """By item: score, question and answer overlap and passage of its best verified entry."""
        seq = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))
        best: dict[object, tuple[float, float, float, int]] = {}
        for p, entry, score in self.retrieve(seq, threshold) if self.entries else ():
            q, a = self.overlap(seq[p * HALF : (p + 2) * HALF], entry)
            item = self.entries[entry].item
            if q >= overlap and a >= overlap and (score, q, a) > best.get(item, (0, 0, 0))[:3]:
                best[item] = (score, q, a, p)
        if self.short:
            at = 0
            for line in (text or "").splitlines():
                own = words_of(line)
                for item in self.short.get(b" ".join(own), ()) if len(own) < MIN_WORDS else ():
                    best.setdefault(item, (1.0, 1.0, 1.0, at // HALF))
                at += len(own)
        return best


def build(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> list[str]:
    """Files of the index shards. Words are counted and entries dealt by tasks; the driver learns the files' names."""
    spark = items.sparkSession
    kind = items.schema[id_col].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, texts = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                words = words_of(text)
                n = -(-len(words) // HALF)
                size = -(-len(words) // n) if n else 1
                for at in range(0, len(words), size):
                    rows.append(i)
                    texts.append(words[at : at + size])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(texts, pa.list_(pa.binary())), pa.array([len(t) for t in texts], pa.int64())], ["item", "words", "n"])

    source = items.select(C.named(id_col).alias("item"), C.named(text_col).cast("string").alias("text"))
    # an item of several entries has no short one: they are cut evenly
    entries = C.mapped(source, cut, C.fields(("item", kind), "words array<binary>, n long")).withColumn("entry", F.monotonically_increasing_id())
    entries = C.stored(entries, "index-entries")
    long = entries.where(F.col("n") >= MIN_WORDS)
    total, mean = long.agg(F.count("*"), F.avg("n")).first()
    terms = long.select("entry", F.explode(F.array_distinct("words")).alias("word"))
    df = terms.groupBy("word").agg(F.count("*").alias("df"))
    idf = df.select("word", F.log1p((total - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weights = terms.join(idf, "word").groupBy("entry").agg(F.collect_list("word").alias("term"), F.collect_list("idf").alias("idf"))
    shards = -(-max(entries.count(), 1) // SHARD_ITEMS)
    rows = entries.join(weights, "entry", "left").withColumn("shard", F.pmod(F.xxhash64("entry"), F.lit(shards)))
    uri = C.scratch(spark, "index")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []

        def done() -> pa.RecordBatch:
            idf: dict[bytes, float] = {}
            short: dict[bytes, list[object]] = {}
            own = []
            for item, words, term, weight in held:
                if term is None:
                    short.setdefault(b" ".join(words), []).append(item)
                else:
                    idf.update(zip(term, weight, strict=True))
                    own.append(Entry(item, words))
            name = f"{uri}/{shard:08d}.index"
            with published(name) as f:
                f.write(pickle.dumps(Index(own, idf, mean or 1.0, short)))
            return pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

        for b in batches:
            for s, *row in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True):
                if s != shard and held:
                    yield done()
                    held = []
                shard = s
                held.append(row)
        if held:
            yield done()

    dealt = rows.repartition(min(shards, C.partitions(spark)), "shard").sortWithinPartitions("shard", "entry")
    with C.batch_rows(spark):
        return sorted(r["name"] for r in C.mapped(dealt.select("shard", "item", "words", "term", "idf"), write, "name string").collect())


@lru_cache(HELD)
def shard(name: str) -> Index:
    with reader(name) as f:
        return pickle.loads(f.read())


def asked(batches: Iterator[pa.RecordBatch], texts_of, names: list[str], threshold: float, overlap: float) -> Iterator[tuple[pa.RecordBatch, list[dict]]]:
    """Batches with what all shards found in each row."""
    held: list[tuple[pa.RecordBatch, list[str | None]]] = []
    size = 0

    def done() -> Iterator[tuple[pa.RecordBatch, list[dict]]]:
        texts = [t for _, own in held for t in own]
        words = [words_of(t) for t in texts]
        best: list[dict] = [{} for _ in texts]
        for name in names:
            index = shard(name)
            for t, w, b in zip(texts, words, best, strict=True):
                for item, found in index.search(t, w, threshold, overlap).items():
                    if found[:3] > b.get(item, (0, 0, 0))[:3]:
                        b[item] = found
        at = 0
        for b, own in held:
            yield b, best[at : at + len(own)]
            at += len(own)

    for b in batches:
        held.append((b, texts_of(b)))
        size += sum(len(t) for t in held[-1][1] if t)
        if size > GROUP_BYTES:
            yield from done()
            held, size = [], 0
    if held:
        yield from done()


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, item_col: str = "item_id") -> DataFrame:
    """(did, seq, item_id, score, question_overlap, answer_overlap, passage): a row for each document row and item found in it; other columns are left out."""
    names = build(items, item_col)
    kind = items.schema[item_col].dataType
    types = (pa.int64(), pa.int64(), to_arrow_type(kind), pa.float64(), pa.float64(), pa.float64(), pa.int32())
    fields = C.fields("did long, seq long", ("item_id", kind), "score double, question_overlap double, answer_overlap double, passage int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in asked(batches, lambda b: b.column(1).to_pylist(), names, threshold, overlap):
            out = []
            for did, text, items_of in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), found, strict=True):
                if items_of:
                    seq = int(np.uint64(xxhash.xxh3_64_intdigest(text)).astype(np.int64))
                    out += [(did, seq, item, *x) for item, x in items_of.items()]
            cols = list(zip(*out, strict=True)) if out else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], fields.names)

    return C.mapped(C.keyed(docs, id_col, text_col).select("did", "text"), run, fields)


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """``docs`` without the rows in which an item is found; needs no shuffle."""
    names = build(items)
    at = docs.columns.index(text_col)
    rows = docs.select(C.whole_row(docs).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in asked(batches, lambda b: b.column(0).field(at).to_pylist(), names, threshold, overlap):
            yield b.filter(pa.array([not x for x in found], pa.bool_()))

    return C.mapped(rows, run, C.fields(("row", rows.schema["row"].dataType))).select("row.*")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    return found.select(C.plain_id().alias("doc_id"), "item_id", "score", "question_overlap", "answer_overlap", "passage")
