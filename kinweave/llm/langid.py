"""Language identification by error-correcting output codes.

Each language has a codeword of bits. One linear classifier a bit, over hashed byte n-grams, tells languages whose
bit is set from the others: its weights are log odds of n-gram rates, from counts per language over labelled rows.
Decoding adds up, for each codeword, the logistic loss of every bit's margin, weighted by how well that bit does on
the labelled rows, and takes the codeword of least loss; the score is its share under a softmax of losses, and a
score under ``AMBIGUOUS`` flags the row.

At most ``sample_rows`` labelled rows are fitted on (chosen by a hash of the id, so the same on every run); all
rows are predicted from their whole text. ``und`` with score 0: null text, no letter, or nothing to learn from.
Rows that are held out (:func:`held_out`) and rows without a language are never learned from; a null id is held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

UNKNOWN = "und"
SAMPLE_ROWS = 40_000
AMBIGUOUS = 0.5
GRAMS = (1, 2, 3, 4)
BUCKETS = 1 << 15
MAX_BITS = 31
_EVIDENCE = 100
_PIECE = 1 << 16
_LETTER = regex.compile(r"\p{L}")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 5 == 0, F.lit(True))


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of all byte n-grams of the lower-cased text, a piece at a time."""
    data = np.frombuffer(f" {text.lower()} ".encode(), np.uint8)
    for at in range(0, len(data), _PIECE):
        part = data[at : at + _PIECE + max(GRAMS) - 1].astype(np.uint32)
        own = min(_PIECE, len(data) - at)
        value = np.zeros(len(part), np.uint32)
        for n in range(1, max(GRAMS) + 1):
            value = (value[: len(part) - n + 1] << np.uint32(8)) | part[n - 1 :]
            if n in GRAMS and len(value):
                yield ((value[:own] + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)


def codewords(n: int) -> np.ndarray:
    """(n, bits) of +1 and -1: every split into two for few languages, else rows of a Hadamard matrix, cut to MAX_BITS columns."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if 2 ** (n - 1) - 1 <= MAX_BITS:
        return np.array([[1 if i == 0 or k >> (i - 1) & 1 else -1 for k in range(2 ** (n - 1) - 1)] for i in range(n)], np.int8)
    size = 1 << n.bit_length()
    row, col = np.arange(1, n + 1)[:, None], np.arange(1, size)[None, :]
    code = np.where(np.bitwise_count(row & col) & 1, -1, 1).astype(np.int8)
    mixed = code[:, np.abs(code.sum(0)) < n]
    return mixed[:, np.random.default_rng(0).permutation(mixed.shape[1])[: max(MAX_BITS, 2 * n.bit_length())]]


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray  # (BUCKETS, bits)
    bias: np.ndarray
    trust: np.ndarray

    def margins(self, text: str) -> np.ndarray:
        """Log odds of each bit, for the evidence of at most _EVIDENCE n-grams."""
        total, n = np.zeros(self.code.shape[1]), 0
        for g in grams(text):
            total += self.weights[g].sum(axis=0)
            n += len(g)
        return total / n * min(n, _EVIDENCE) + self.bias

    def losses(self, margins: np.ndarray) -> np.ndarray:
        return (np.logaddexp(0, -self.code * margins) * self.trust).sum(axis=1)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or text is None or not _LETTER.search(text):
            return UNKNOWN, 0.0
        loss = self.losses(self.margins(text))
        share = np.exp(loss.min() - loss)
        best = int(loss.argmin())
        return self.langs[best], float(share[best] / share.sum())


def _counts(rows: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, their n-gram counts and numbers of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = own.setdefault(lang, np.zeros(BUCKETS, np.int64))
                docs[lang] = docs.get(lang, 0) + 1
                for g in grams(text):
                    c += np.bincount(g, minlength=BUCKETS)
        for lang, c in own.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1)), pa.array(np.r_[-1, at]), pa.array(np.r_[docs[lang], c[at]])], ["lang", "bucket", "n"])

    # added up by bucket; what reaches the driver is at most BUCKETS + 1 rows a language
    with C.batch_rows(rows.sparkSession):
        total = C.mapped(rows, run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(total.column("lang").to_pylist()))
    index = {x: i for i, x in enumerate(langs)}
    counts, docs = np.zeros((len(langs), BUCKETS)), np.zeros(len(langs))
    who = np.array([index[x] for x in total.column("lang").to_pylist()], np.int64)
    bucket, n = total.column("bucket").to_numpy(), total.column("n").to_numpy()
    grams_of = bucket >= 0
    counts[who[grams_of], bucket[grams_of]] = n[grams_of]
    docs[who[~grams_of]] = n[~grams_of]
    return langs, counts, docs


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    usable = docs.where(~held_out(id_col) & F.col(f"`{lang_col}`").isNotNull())
    # null texts never count as labelled; the test on text is left to the reading of the sample
    n = usable.count()
    keep = F.pmod(F.xxhash64(F.col(f"`{id_col}`").cast("string")), F.lit(1_000_003)) < int(1_000_003 * min(1.0, sample_rows / max(n, 1)))
    sample = usable.where(keep & F.col(f"`{text_col}`").rlike(r"\p{L}")).select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    langs, counts, rows = _counts(sample)
    code = codewords(len(langs))
    weights, bias = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1])
    rate = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS) if len(langs) else counts
    for b in range(code.shape[1] if len(langs) > 1 else 0):
        one, two = rate[code[:, b] > 0], rate[code[:, b] < 0]
        weights[:, b] = np.log(one.mean(axis=0)) - np.log(two.mean(axis=0))
    model = Model(langs, code, weights, bias, np.ones(code.shape[1]))
    if len(langs) > 1:
        model.trust = _trust(sample, model)
    return model


def _trust(sample: DataFrame, model: Model) -> np.ndarray:
    """Weight of each bit: log odds of its being right on the labelled rows, over their mean."""
    spark = sample.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        index = {x: i for i, x in enumerate(m.langs)}
        right, n = np.zeros(m.code.shape[1], np.int64), 0
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                right += m.code[index[lang]] * m.margins(text) > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(right))), pa.array(right), pa.array(np.full(len(right), n))], ["bit", "right", "n"])

    out = np.ones(model.code.shape[1])
    with C.batch_rows(spark):
        found = C.mapped(sample, run, "bit long, right long, n long").groupBy("bit").agg(F.sum("right").alias("right"), F.sum("n").alias("n")).collect()  # a row a bit
    for r in found:
        share = (r["right"] + 1) / (r["n"] + 2)
        out[r["bit"]] = max(np.log(share / (1 - share)), 0.01)
    return out / out.mean()


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` as ``row`` (a struct of all columns), with lang_pred, score and ambiguous."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(C.whole_row(docs).alias("row"))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            said = [m.predict(t) for t in b.column(0).field(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in said], pa.string()), pa.array([s for _, s in said], pa.float64()), pa.array([s < AMBIGUOUS for _, s in said], pa.bool_())], ["row", "lang_pred", "score", "ambiguous"])

    return C.mapped(rows, run, C.fields(("row", rows.schema["row"].dataType), "lang_pred string, score double, ambiguous boolean"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    model = train(docs.select("doc_id", "text", "lang"))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("row.doc_id", held_out("row`.`doc_id").alias("held_out"), "lang_pred", "score")
