"""Suffix-array dedup over bytes with longest-previous-factor arrays.

A repeated string of ``length`` bytes has the same smallest ``GRAM``-byte hash wherever it stands, so the string
starts of a document fall into runs of one smallest hash, and equal strings meet under equal hashes. Hashes seen
twice go into a bit filter of fixed size; texts without any are done in that pass. The bytes under each flagged run
are its context. Contexts that stand twice, by 128-bit digest, are covered whole. Where a hash has several contexts,
their bytes meet: a suffix array over them, cut at ``length`` bytes, gives previous and next smaller positions and
with them longest-previous-factor arrays, forwards and mirrored. Starts whose string has a hash of its own there are
left out before sorting; matches are of bytes. A hash with over ``HOT_CONTEXTS`` contexts, what one task holds, is
not brought together: its strings are counted one by one by 128-bit digest, so any number of tasks share it.
Copies of a whole text are counted by 128-bit digest, and a task takes contexts of one copy only.

Texts are UTF-8 bytes; null counts as empty; texts under ``length`` stay whole. Rows are documents, whatever their
id: two rows with one id are two places. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

LENGTH, GRAM = 200, 32
HOT_CONTEXTS = 4096
_SEGMENT, _CHUNK, _SCAN = 1 << 18, 1 << 18, 1 << 16
_SEEN = 200_000
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_COPY, _TWICE = np.uint64(0x5851F42D4C957F2D), np.uint64(0x2545F4914F6CDD1D)
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_SPANS_SQL = "array<struct<start:bigint,end:bigint>>"


# --- longest previous factors -------------------------------------------------------------------


def _loads(data: np.ndarray, order: str) -> np.ndarray:
    return np.ndarray(len(data) - 7, f"{order}u8", data.tobytes(), strides=(1,))


def prefix_ranks(data: np.ndarray, cap: int) -> list[tuple[int, np.ndarray]]:
    """(n, ranks): order of the n-byte strings at each position, for n = 8, 16, .. and last n = cap (8 at least)."""
    assert cap >= 8
    out = [(8, np.unique(_loads(data, ">"), return_inverse=True)[1].astype(np.int32))]
    while out[-1][0] < cap:
        n, r = out[-1]
        more = min(n, cap - n)
        pair = r[: len(r) - more].astype(np.int64) * (len(r) + 1) + r[more:]
        out.append((n + more, np.unique(pair, return_inverse=True)[1].astype(np.int32)))
    return out


def nearest_smaller(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest smaller value before and after each one; -1 where there is none."""

    def before(v: np.ndarray) -> np.ndarray:
        at = np.arange(len(v)) - 1
        live = np.flatnonzero(at >= 0)
        while len(live := live[v[at[live]] > v[live]]):
            at[live] = at[at[live]]  # what lies between is larger
            live = live[at[live] >= 0]
        return at

    after = len(values) - 1 - before(values[::-1])[::-1]
    return before(values), np.where(after == len(values), -1, after)


def longest_factors(data: np.ndarray, starts: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """For ascending starts, each with cap bytes of its own: longest match, up to cap, with an earlier and with a later start."""
    levels = prefix_ranks(data, cap)
    last = levels[-1][1][starts]
    order = np.argsort(last, kind="stable")
    pos = starts[order]

    def common(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        whole = levels[-1][1][i] == levels[-1][1][j]
        for n, r in reversed(levels[:-1]):
            fit = out + n <= cap
            a, b = np.where(fit, i + out, 0), np.where(fit, j + out, 0)
            out += n * (fit & (r[a] == r[b]))
        tail = np.ones(len(i), bool)
        for _ in range(7):
            at = np.minimum(out, cap - 1)
            tail &= (out < cap) & (data[i + at] == data[j + at])
            out += tail
        return np.where(whole, cap, out)

    def best(values: np.ndarray) -> np.ndarray:
        found = np.zeros(len(pos), np.int64)
        for near in nearest_smaller(values):
            k = np.flatnonzero(near >= 0)
            found[k] = np.maximum(found[k], common(pos[k], pos[near[k]]))
        out = np.empty_like(found)
        out[order] = found
        return out

    return best(pos), best(-pos)


# --- runs of one smallest hash -------------------------------------------------------------------


class Runs:
    """Runs of string starts with one smallest hash, of several texts: text, key, first and last start, and whether the key stands at several places of the text."""

    def __init__(self, texts: list[bytes], length: int):
        self.length, self.gram = length, min(GRAM, length // 2 // 8 * 8)
        parts, held, size = [], [], 0
        for row, text in enumerate(texts):
            for at in range(0, len(text) - length + 1, _SEGMENT):
                piece = text[at : at + _SEGMENT + length - 1]
                held.append((row, at, piece))
                size += len(piece)
                if size >= _SCAN:
                    parts.append(self._scan(held))
                    held, size = [], 0
        if held:
            parts.append(self._scan(held))
        none = np.zeros(0, np.int64)
        cols = zip(*parts, strict=True) if parts else [[none], [none.astype(np.uint64)], [none], [none], [none.astype(bool)]]
        self.row, self.key, self.first, self.last, self.again = (np.concatenate(x) for x in cols)
        # one row for each key of a text; runs of one key in different places count as several
        order = np.lexsort((self.key, self.row))
        new = np.r_[True, (self.key[order][1:] != self.key[order][:-1]) | (self.row[order][1:] != self.row[order][:-1])][: len(order)]
        group = np.cumsum(new) - 1
        many = np.bincount(group) > 1 if len(group) else np.zeros(0, bool)
        np.logical_or.at(many, group, self.again[order])
        self.again[order] = many[group]
        self.distinct = order[new]

    def _scan(self, pieces: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
        length, gram = self.length, self.gram
        size = np.array([len(p) for _, _, p in pieces])
        ends = np.cumsum(size)
        begins = ends - size
        v = _loads(np.frombuffer(b"".join([p for _, _, p in pieces]), np.uint8), "<").copy()
        n = int(ends[-1]) - gram + 1
        with np.errstate(over="ignore"):
            h = v[:n] * _MULT[0]
            for j in range(8, gram, 8):
                h += v[j : n + j] * _MULT[j // 8]
            h = C.mix64(h)
        low, width, want = h, 1, length - gram + 1
        while width < want:
            more = min(width, want - width)
            low = np.minimum(low[:-more], low[more:])
            width += more
        count = size - length + 1
        piece = np.repeat(np.arange(len(pieces)), count)
        at = np.arange(len(piece)) + (begins - (np.cumsum(count) - count))[piece]
        low = low[at]
        first = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (piece[1:] != piece[:-1])])
        last = np.r_[first[1:], len(low)] - 1
        key, own = low[first], piece[first]
        small = np.zeros(1 << 16, bool)
        small[(key & np.uint64(0xFFFF)).astype(np.int64)] = True
        place = np.flatnonzero(small[(h & np.uint64(0xFFFF)).astype(np.int64)])
        # a hash together with its piece; a chance meeting costs work only
        with np.errstate(over="ignore"):
            seen = np.sort(h[place] + np.searchsorted(ends, place, "right").astype(np.uint64) * _MULT[0])
            mine = key + own.astype(np.uint64) * _MULT[0]
        again = np.searchsorted(seen, mine, "right") - np.searchsorted(seen, mine, "left") > 1
        row, shift = np.array([r for r, _, _ in pieces]), np.array([a for _, a, _ in pieces])
        move = shift[own] - begins[own]
        return row[own], key, at[first] + move, at[last] + move, again


def _digest(parts: list[bytes]) -> np.ndarray:
    """(n, 2): 128-bit digests."""
    if not parts:
        return np.zeros((0, 2), np.uint64)
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, parts)), np.uint64).reshape(-1, 2)


# --- the operator --------------------------------------------------------------------------------


Emit = Callable[[pa.RecordBatch, list[bytes], list[list[dict[str, int]]]], pa.RecordBatch]
_SPAN_SQL = "struct<start:bigint,end:bigint>"


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, filter_bits: int = C.FILTER_BITS, emit: Emit | None = None, fields: str | T.StructType | None = None) -> DataFrame:
    """(did, text, rest, spans): spans are [start, end) byte ranges covered by strings of ``length`` that stand elsewhere too.

    ``emit`` makes other columns (``fields``) of a batch (did, text, rest), its texts and their spans, in the same pass.
    """
    assert length >= 16
    spark: SparkSession = docs.sparkSession
    rows = C.keyed(docs, id_col, text_col)
    rest = rows.schema["rest"].dataType
    if emit is None:
        fields = C.fields("did long, text string", ("rest", rest), f"spans {_SPANS_SQL}")

        def emit(b: pa.RecordBatch, texts: list[bytes], spans: list[list[dict[str, int]]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*b.columns, pa.array(spans, _SPANS)], names=[*b.schema.names, "spans"])

    fields = T.StructType.fromDDL(fields) if isinstance(fields, str) else fields

    def key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unlike = np.random.default_rng()
        for b in batches:
            texts = list(C.texts_of(b, "text"))
            r = Runs(texts, length)
            seq = _digest(texts)[:, 0]
            whole = np.array([len(t) >= length for t in texts])
            key, tag = r.key[r.distinct], seq[r.row[r.distinct]]
            twice = r.again[r.distinct]
            keys = np.concatenate([key, key[twice], seq[whole] ^ _COPY])
            tags = np.concatenate([tag, tag[twice] ^ _TWICE, unlike.integers(0, 2**64, int(whole.sum()), np.uint64)])
            yield pa.RecordBatch.from_arrays([C.signed(keys), C.signed(tags)], ["key", "tag"])

    found = C.mapped(rows.select("text"), key_rows, "key long, tag long")
    hot = found.groupBy("key").agg(F.min("tag").alias("lo"), F.max("tag").alias("hi")).where("lo <> hi").select("key")
    bitmap = spark.sparkContext.broadcast(C.bit_filter(hot, "key", filter_bits))

    def sort_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts without a flagged key are done (``out``); of the others the flagged runs are kept."""
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            texts = list(C.texts_of(b, "text"))
            ids, r = _digest(texts), Runs(texts, length)
            k = np.flatnonzero(C.in_filter(bitmap.value, r.key))
            flag = C.in_filter(bitmap.value, ids[:, 0] ^ _COPY) & np.array([len(t) >= length for t in texts])
            flag[r.row[k]] = True
            clean, hit = np.flatnonzero(~flag), np.flatnonzero(flag)
            done = emit(b.take(pa.array(clean)), [texts[i] for i in clean], [[] for _ in clean])
            done = pa.StructArray.from_arrays(done.columns, names=done.schema.names)
            k = k[np.argsort(r.row[k], kind="stable")]
            cut = np.searchsorted(r.row[k], [*hit, len(texts)])
            kept = pa.StructArray.from_arrays([C.signed(r.key[k]), pa.array(r.first[k]), pa.array(r.last[k]), pa.array(r.again[k])], names=["key", "first", "last", "again"])
            own = [pa.array(row + np.arange(len(hit))), C.signed(ids[hit, 0]), C.signed(ids[hit, 1]), *b.take(pa.array(hit)).columns, pa.ListArray.from_arrays(pa.array(cut, pa.int32()), kept), pa.nulls(len(hit), done.type)]
            names = ["u", "s1", "s2", *b.schema.names, "runs", "out"]
            row += len(hit)
            yield pa.RecordBatch.from_arrays(own, names)
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(clean), x.type) for x in own[:-1]], done], names)

    kinds = C.fields("u long, s1 long, s2 long, did long, text string", ("rest", rest), "runs array<struct<key:bigint,first:bigint,last:bigint,again:boolean>>", ("out", fields))
    sorted_out = C.stored(C.mapped(rows, sort_out, kinds), "byte-repeats", codec="zstd")
    hits = sorted_out.where("u is not null")

    def sources(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes], np.ndarray, pa.StructArray]]:
        """Texts and flagged runs, of copies of one text the first that the task meets: rows, and the row of each run."""
        seen: set[tuple[int, int]] = set()
        for b in batches:
            s = list(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
            new = []
            for i, x in enumerate(s):
                if x not in seen:
                    seen.add(x)
                    new.append(i)
            b = b.take(pa.array(new, pa.int64()))
            runs = b.column(4)
            yield b, list(C.texts_of(b, "text")), np.repeat(np.arange(len(new)), runs.value_lengths().to_numpy()), runs.flatten()

    def place_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts, row, runs in sources(batches):
            first, last = (runs.field(c).to_numpy() for c in ("first", "last"))
            size = last - first + length
            ids = _digest([texts[i][a : a + n] for i, a, n in zip(row.tolist(), first.tolist(), size.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([runs.field("key"), C.signed(ids[:, 0]), C.signed(ids[:, 1]), pa.array(b.column(0).to_numpy()[row]), pa.array(first), pa.array(size.astype(np.int32)), runs.field("again")], ["key", "c1", "c2", "u", "at", "size", "again"])

    source = hits.select("u", "s1", "s2", "text", "runs")
    places = C.stored(C.mapped(source, place_rows, "key long, c1 long, c2 long, u long, at long, size int, again boolean"), "byte-places")
    distinct = C.stored(places.groupBy("key", "c1", "c2").agg(F.count("*").alias("n"), F.max("again").alias("again")), "byte-contexts")
    span = lambda a, z: F.struct(a.cast("long").alias("start"), z.cast("long").alias("end"))
    twice = C.joined(places.select("key", "c1", "c2", "u", "at", "size"), distinct.where("n > 1").select("key", "c1", "c2", "n"), ["key", "c1", "c2"], "n")
    parts = twice.select("u", span(F.col("at"), F.col("at") + F.col("size")).alias("span"))

    # keys whose contexts have to be looked into, and of these the hot ones; a filter says the same of all contexts of a key
    keys = distinct.groupBy("key").agg(F.count("*").alias("contexts"), F.max("again").alias("again")).where("contexts > 1 or again")
    keys = C.stored(keys, "byte-keys")
    too_large = keys.where(F.col("contexts") > HOT_CONTEXTS)
    hot_keys = None if too_large.isEmpty() else spark.sparkContext.broadcast(C.bit_filter(too_large, "key", filter_bits))
    is_hot = lambda key: np.zeros(len(key), bool) if hot_keys is None else C.in_filter(hot_keys.value, key.view(np.uint64))
    wanted = spark.sparkContext.broadcast(C.bit_filter(keys, "key", filter_bits))

    def context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()  # of equal contexts of a task one goes, as far as this set reaches
        for b, texts, row, runs in sources(batches):
            key, first, last = (runs.field(c).to_numpy() for c in ("key", "first", "last"))
            k = np.flatnonzero(C.in_filter(wanted.value, key.view(np.uint64)) & ~is_hot(key))
            out, contexts = [], []
            for i, a, z in zip(k.tolist(), first[k].tolist(), last[k].tolist(), strict=True):
                context = texts[row[i]][a : z + length]
                ident = xxhash.xxh3_128_digest(context)
                if ident not in sent:
                    sent.add(ident)
                    out.append(i)
                    contexts.append(context)
            if len(sent) > _SEEN:
                sent.clear()
            yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(b.column(0).to_numpy()[row[out]]), pa.array(first[out]), runs.field("again").take(pa.array(out, pa.int64())), pa.array(contexts, pa.binary())], ["key", "u", "at", "again", "context"])

    def factor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, u, at, again, context in _by_key(batches):
            spans = context_spans(key, again, context, length)
            n = [len(s) for s in spans]
            flat = [{"start": a + x["start"], "end": a + x["end"]} for a, s in zip(at, spans, strict=True) for x in s]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(u, np.int64), n)), pa.array(flat, _SPANS.value_type)], ["u", "span"])

    met = C.mapped(source, context_rows, "key long, u long, at long, again boolean, context binary")
    together = met.repartition(C.partitions(spark), "key").sortWithinPartitions("key")
    parts = parts.unionByName(C.mapped(together, factor_rows, f"u long, span {_SPAN_SQL}", 4096))

    def string_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts, row, runs in sources(batches):
            key, first, last = (runs.field(c).to_numpy() for c in ("key", "first", "last"))
            u = b.column(0).to_numpy()
            for i in np.flatnonzero(is_hot(key)).tolist():
                at = np.arange(first[i], last[i] + 1)
                ids = _digest([texts[row[i]][a : a + length] for a in at.tolist()])
                yield pa.RecordBatch.from_arrays([C.signed(ids[:, 0]), C.signed(ids[:, 1]), pa.array(np.full(len(at), u[row[i]])), pa.array(at)], ["h1", "h2", "u", "at"])

    if hot_keys is not None:
        strings = C.stored(C.mapped(source, string_rows, "h1 long, h2 long, u long, at long"), "byte-strings")
        met_twice = C.stored(strings.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1"), "byte-strings-twice")
        found = C.joined(strings, met_twice, ["h1", "h2"], "n")
        parts = parts.unionByName(found.select("u", span(F.col("at"), F.col("at") + length).alias("span")))

    copies = C.stored(hits.groupBy("s1", "s2").agg(F.count("*").alias("n")).where("n > 1"), "byte-copies")
    whole = C.joined(hits.select("u", "s1", "s2"), copies, ["s1", "s2"], "n").select("u", F.lit(True).alias("whole"))
    decided = parts.groupBy("u").agg(F.collect_set("span").alias("parts")).join(whole, "u", "full")

    def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = list(C.texts_of(b, "text"))
            out = [[{"start": 0, "end": len(t)}] if all_of else join_spans(p or []) for t, p, all_of in zip(texts, b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            yield emit(b.select([0, 1, 2]), texts, out)

    resolved = hits.select("u", "did", "text", "rest").join(decided, "u", "left").select("did", "text", "rest", "parts", "whole")
    return sorted_out.where("u is null").select("out.*").unionByName(C.stored(C.mapped(resolved, repeats, fields), "byte-repeats-cut"))


def context_spans(key: list[int], again: list[bool], context: list[bytes], length: int) -> list[list[dict[str, int]]]:
    """Spans of each context covered by strings that also stand in another context of its key, or twice in one.

    Rows come by key. Of equal contexts one row stands for all, as their spans are known from their number.
    """
    spans: list[list[dict[str, int]]] = [[] for _ in context]
    first: dict[tuple[int, bytes], int] = {}
    many: dict[int, int] = {}
    for i, own in enumerate(zip(key, context, strict=True)):
        if first.setdefault(own, i) == i:
            many[own[0]] = many.get(own[0], 0) + 1
    rows = [i for own, i in first.items() if many[own[0]] > 1 or again[i]]
    if not rows:
        return spans
    data = np.frombuffer(b"".join([context[i] for i in rows]), np.uint8)
    ends = np.cumsum([len(context[i]) for i in rows])
    begin = np.r_[0, ends[:-1]]
    n = ends - begin - length + 1
    starts = np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)
    own = np.repeat(np.arange(len(rows)), n)
    # strings that stand once here, by hash, are in no factor of this length
    _, at, count = np.unique(_string_hashes(data, length)[starts], return_inverse=True, return_counts=True)
    live = count[at] > 1
    starts, own = starts[live], own[live]
    if not len(starts):
        return spans
    # a suffix array of the contexts that are left
    used, place = np.unique(own, return_inverse=True)
    size = ends[used] - begin[used]
    moved = np.cumsum(size) - size
    kept = np.concatenate([data[begin[i] : ends[i]] for i in used.tolist()])
    local = starts - begin[used][place] + moved[place]
    earlier, later = longest_factors(kept, local, length)
    hit = np.maximum(earlier, later) >= length
    local, place = local[hit] - moved[place[hit]], place[hit]
    if len(local):
        for part in np.split(np.arange(len(local)), np.flatnonzero(np.diff(place)) + 1):
            spans[rows[used[place[part[0]]]]] = merge_spans(local[part], length)
    return spans


def _string_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the string of ``length`` bytes at each position, by doubling."""
    with np.errstate(over="ignore"):
        h, n = C.mix64(_loads(data, "<").copy()), 8
        while n < length:
            more = min(n, length - n)
            h = C.mix64(h[:-more] * _MULT[0] + h[more:])
            n += more
    return h


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """Columns (key, u, at, again, context) of rows of whole keys, about _CHUNK bytes of contexts together, from rows sorted by key."""
    held: list[list] = [[], [], [], [], []]
    size = 0
    for b in batches:
        for row in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True):
            if size > _CHUNK and row[0] != held[0][-1]:
                yield held
                held, size = [[], [], [], [], []], 0
            for to, x in zip(held, row, strict=True):
                to.append(x)
            size += len(row[4])
    if size:
        yield held


def merge_spans(starts: np.ndarray, length: int) -> list[dict[str, int]]:
    cut = np.flatnonzero(np.diff(starts) > length)
    lo, hi = starts[np.r_[0, cut + 1]], starts[np.r_[cut, len(starts) - 1]] + length
    return [{"start": int(a), "end": int(b)} for a, b in zip(lo, hi, strict=True)]


def join_spans(parts: list[dict[str, int]]) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    for p in sorted(parts, key=lambda p: p["start"]):
        if out and p["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], p["end"])
        else:
            out.append(dict(p))
    return out


def earlier_factors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, start, length): for every text by itself, maximal later copies of ``length`` bytes or more inside it, the first being kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for did, text in zip(b.column(0).to_pylist(), C.texts_of(b, "text"), strict=True):
                if len(text) > length:
                    starts = np.arange(len(text) - length + 1)
                    earlier = longest_factors(np.frombuffer(text, np.uint8), starts, length)[0]
                    at = starts[earlier >= length]
                    if len(at):
                        s = merge_spans(at, length)
                        yield pa.RecordBatch.from_arrays([pa.array([did] * len(s), pa.int64()), pa.array([x["start"] for x in s], pa.int64()), pa.array([x["end"] - x["start"] for x in s], pa.int64())], ["did", "start", "length"])

    return C.mapped(C.keyed(docs, id_col, text_col).select("did", "text"), run, "did long, start long, length long")


def digests(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) from the spans of :func:`find_repeats`."""

    def emit(b: pa.RecordBatch, texts: list[bytes], spans: list[list[dict[str, int]]]) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        for text, own in zip(texts, spans, strict=True):
            kept = remaining(text, own)
            for to, x in zip(out, (len(text), len(text) - len(kept), len(own), hashlib.sha256(kept).hexdigest()), strict=True):
                to.append(x)
        return pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, pa.int64()) for x in out[:3]], pa.array(out[3], pa.string())], ["did", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = find_repeats(docs, emit=emit, fields="did long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", **how)
    return out.select(C.plain_id().alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def remaining(text: bytes, spans: list[dict[str, int]]) -> bytes:
    out, at = [], 0
    for s in spans:
        out.append(text[at : s["start"]])
        at = s["end"]
    return b"".join([*out, text[at:]])


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(C.table(spark, sf_dir, "documents"))
