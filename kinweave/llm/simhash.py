"""SimHash near-dedup by tiled exact comparison.

Distinct fingerprints are dealt into tiles of one population count and bounded size. Two tiles meet only where
their counts differ by no more than the radius; inside, numpy exclusive-or and bit counts compare every pair of
fingerprints. A meeting emits a spanning forest of its links, not the links, so a group of thousands of copies
costs one row a member. Components follow from large-star / small-star rounds.

Near copies by similarity: wide fingerprints (``WORDS`` x 64 bits) of distinct five-word shingles. SimHash distance
measures an angle, and sets of Jaccard similarity s and like size have the cosine 2s / (1 + s); the radius is the
distance that angle gives. Only sets meet whose sizes allow the similarity (the smaller has s times the larger at
least). Meetings filter on the first 64 bits, then on all. What they link are candidates: inside each group of them the
exact Jaccard similarity of the shingle sets decides.

Null text: no words, fingerprint zero, linked like any other. Null id: after every other id. Rows with one id and
different fingerprints all stay; rows with one fingerprint share a component. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SEED = 42
TILE_MAX, TILE_MIN, TILES = 131_072, 2_048, 16
#: Fingerprints compared at a time: few rows, so that what is made of them stays in a core's cache.
_ROWS, _COLS = 32, 1 << 13


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 of each run of k words, repeats included; of the whole sequence if shorter; none without words."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    lo = [0, *end[: len(words) - k].tolist()]
    hi = (end[k - 1 :] - 1).tolist()
    return np.fromiter(map(xxhash.xxh64_intdigest, [joined[a:b] for a, b in zip(lo, hi, strict=True)], repeat(SEED)), np.uint64, len(hi))


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def _majority(hashes: np.ndarray) -> np.ndarray:
    """Of (n, words) hashes, the words whose bits are set in over half of the rows."""
    size = 8 * hashes.shape[1]
    count = np.zeros((size, 256))
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)]).astype("<u8").view(np.uint8).reshape(-1, size)
        count += np.bincount((part + np.arange(0, 256 * size, 256)).ravel(), minlength=256 * size).reshape(size, 256)
    return np.packbits((2 * (count @ _BITS) > len(hashes)).ravel(), bitorder="little").view("<u8")


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if over half of the hashes have it."""
    return int(_majority(hashes[:, None])[0])


def wide_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """``fingerprint`` of the hashes, then of others made from them."""
    with np.errstate(over="ignore"):
        more = C.mix64(hashes[:, None] + np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    more[:, 0] = hashes
    return _majority(more).astype(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(did, fp): one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(shingle_hashes(t.lower().split(), shingle)) for t in C.texts_of(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column(0), C.signed(np.array(fp, np.uint64))], ["did", "fp"])

    return C.mapped(C.keyed(docs, id_col, text_col).select("did", "text"), run, "did long, fp long")


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels of n nodes."""
    lab = np.arange(n)
    while True:
        low = np.minimum(lab[a], lab[b])
        new = lab.copy()
        np.minimum.at(new, lab[a], low)
        np.minimum.at(new, lab[b], low)
        new = new[new]
        if np.array_equal(new, lab):
            return lab
        lab = new


def tile_links(x: np.ndarray, y: np.ndarray | None, radius: int, wide: np.ndarray | None = None, wide_radius: tuple[int, int] = (0, 0)) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside x (y None) or between x and y, as indexes into x followed by y.

    With ``wide``, the wide fingerprints of both in that order, links also need distances of wide_radius at most, in the
    first two words and in all.
    """
    same = y is None
    y = x if same else y
    n, shift = len(x) + (0 if same else len(y)), 0 if same else len(x)
    a, b, held = [], [], 0

    def forest() -> tuple[np.ndarray, np.ndarray]:
        if not a:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lab = _labels(n, np.concatenate(a), np.concatenate(b))
        node = np.flatnonzero(lab != np.arange(n))
        return node, lab[node]

    second = None if wide is None else np.ascontiguousarray(wide[:, 1])
    for i in range(0, len(x), _ROWS):
        for j in range(i if same else 0, len(y), _COLS):
            count = np.bitwise_count(x[i : i + _ROWS, None] ^ y[None, j : j + _COLS])
            hit = np.flatnonzero(count <= radius)
            if len(hit):
                r, c = divmod(hit, count.shape[1]) if count.shape[1] != _COLS else (hit >> 13, hit & (_COLS - 1))
                r, c = r + i, c + j + shift
                if wide is not None:
                    # the first word is the fingerprint itself
                    near = count.ravel()[hit] + np.bitwise_count(second[r] ^ second[c]) <= wide_radius[0]
                    r, c = r[near], c[near]
                if wide is not None and len(r):
                    far = np.concatenate([np.bitwise_count(wide[r[k : k + 65536]] ^ wide[c[k : k + 65536]]).sum(axis=1) for k in range(0, len(r), 65536)])
                    r, c = r[far <= wide_radius[1]], c[far <= wide_radius[1]]
                a.append(r)
                b.append(c)
                held += len(r)
                if held > 500_000:
                    p, q = forest()
                    a, b, held = [p], [q], len(p)
    return forest()


def size_class(n: Column, similarity: float) -> Column:
    """Classes of set sizes, four to a factor of 1 / similarity: sets of this similarity are ``SIZE_REACH`` classes apart at most."""
    steps = SIZE_REACH / -np.log(similarity) * (1 - 1e-6)  # a little wide, so that rounding parts no pair
    return F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) * steps).cast("int")


SIZE_REACH = 4


def tile_pairs(reps: DataFrame, radius: int) -> DataFrame:
    """(x, y): tiles (arrays of the columns of reps) that have to meet; y null for a tile by itself.

    Tiles hold a class of population counts, or of what the column ``class`` has: tiles up to SIZE_REACH classes apart meet.
    """
    if "class" in reps.columns:
        reach, tiled = SIZE_REACH, reps.withColumnRenamed("class", "p")
        reps = reps.drop("class")
    else:
        step = max(1, radius // 2)
        reach = (radius + step - 1) // step
        tiled = reps.withColumn("p", F.expr(f"cast(bit_count(fp) div {step} as int)"))
    count = {int(r["p"]): int(r["n"]) for r in tiled.groupBy("p").agg(F.count("*").alias("n")).collect()}  # 65 rows at most, or some hundreds of size classes
    last = max(count, default=0)
    size = min(TILE_MAX, max(TILE_MIN, sum(count.values()) // TILES))
    slots = F.array(*[F.lit(-(-count.get(p, 0) // size)) for p in range(last + 1)])
    tiled = tiled.withColumn("s", F.pmod(F.xxhash64("fp"), F.greatest(F.lit(1), slots[F.col("p")])).cast("int"))
    tiles = tiled.groupBy("p", "s").agg(F.collect_list(F.struct(*reps.columns)).alias("tile"))
    slot_type = "array<struct<p:int,s:int>>"

    def meetings(q: Column) -> Column:
        n = F.get(slots, q)
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda s: F.struct(q.alias("p"), s.alias("s")))).otherwise(F.lit(None).cast(slot_type))

    classes = F.sequence(F.greatest(F.col("p") - reach, F.lit(0)), F.least(F.col("p") + reach, F.lit(last)))
    near = F.flatten(F.filter(F.transform(classes, meetings), lambda x: x.isNotNull()))
    sent = tiles.select(F.struct("p", "s").alias("own"), "tile", F.explode(near).alias("other"))
    sent = sent.select("own", "tile", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    first, second = F.col("own") == F.col("lo"), (F.col("own") == F.col("hi")) & (F.col("lo") != F.col("hi"))
    dealt = sent.repartition(4 * C.partitions(reps.sparkSession), "lo", "hi")
    return dealt.groupBy("lo", "hi").agg(*[F.first(F.when(side, F.col("tile")), ignorenulls=True).alias(name) for name, side in (("x", first), ("y", second))])


def links(reps: DataFrame, radius: int, wide_radius: tuple[int, int] = (0, 0)) -> DataFrame:
    """(a, b): representatives whose fingerprints differ in at most ``radius`` bits, reduced to spanning forests.

    reps: (fp, rep), and for similarity (fp, rep, wide, class). A pair of tiles is a row of some megabytes: they travel one by one.
    """
    has_wide = "wide" in reps.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                parts = [t.values if (t := b.column(name)[k]).is_valid else None for name in ("x", "y")]
                fp = [None if p is None else p.field("fp").to_numpy(zero_copy_only=False).view(np.uint64) for p in parts]
                rep = np.concatenate([p.field("rep").to_numpy(zero_copy_only=False) for p in parts if p is not None])
                wide = None
                if has_wide:
                    wide = np.concatenate([np.frombuffer(b"".join(p.field("wide").to_pylist()), np.uint64).reshape(len(p), -1) for p in parts if p is not None])
                node, to = tile_links(fp[0], fp[1], radius, wide, wide_radius)
                yield pa.RecordBatch.from_arrays([pa.array(rep[node]), pa.array(rep[to])], ["a", "b"])

    return C.stored(C.mapped(tile_pairs(reps, radius).select("x", "y"), run, "a long, b long", 1), "tile-links", rows=1)


def components(prints: DataFrame, radius: int = 3) -> DataFrame:
    """(did, fp, component) for (did, fp); component is the smallest id reachable over links, itself included."""
    prints = C.stored(prints, "fingerprints")
    reps = C.stored(prints.groupBy("fp").agg(F.min("did").alias("low"), F.count("*").alias("n")), "representatives")
    # fingerprints are the nodes: ids may be null or stand twice
    found = C.connected_components(links(reps.select("fp", F.col("fp").alias("rep")), radius), "simhash")
    linked = reps.join(found, reps.fp == found.node, "left").select("fp", "low", "n", F.coalesce("component", "fp").alias("class"))
    lows = linked.groupBy("class").agg(F.min("low").alias("component"))
    classes = C.stored(linked.join(lows, "class").select("fp", "component", "n"), "classes")
    return C.joined(prints, classes, ["fp"], "n").select("did", "fp", "component")


# --- near copies by similarity -------------------------------------------------------------------

SHINGLE, SIMILARITY, WORDS = 5, 0.8, 16
#: Candidates reach so many standard deviations beyond the expected distance, on the first 64 bits and on all.
FIRST_SPREAD, SPREAD = 5, 6
#: Where the smaller set has fewer shingles, ties spoil the distance; shared shingles make the candidates.
FEW = 32


def radius_of(similarity: float, bits: int) -> int:
    """Expected distance of fingerprints of two shingle sets with this Jaccard similarity."""
    return round(np.arccos(2 * similarity / (1 + similarity)) / np.pi * bits)


def reach_of(similarity: float, bits: int, spread: float) -> int:
    far = radius_of(similarity, bits)
    return int(far + spread * np.sqrt(far * (1 - far / bits)))


def _head(n: int, similarity: float) -> int:
    """Two sets of this similarity share one of so many first hashes of either, in any one order of all hashes."""
    return n - int(np.ceil(similarity * n - 1e-9)) + 1


def _few_links(nodes: DataFrame) -> DataFrame:
    """(a, b): candidates among sets of which one may have under ``FEW`` shingles; each meets the smallest that shares a first hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads = [np.frombuffer(x, np.uint64) for x in b.column(1).to_pylist()]
            node = np.repeat(b.column(0).to_numpy(), [len(x) for x in heads])
            yield pa.RecordBatch.from_arrays([pa.array(node), C.signed(np.concatenate([np.zeros(0, np.uint64), *heads]))], ["node", "hash"])

    found = C.stored(C.mapped(nodes.where("heads is not null").select("node", "heads"), run, "node long, hash long").distinct(), "first-hashes")
    low = C.stored(found.groupBy("hash").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1"), "first-hash-groups")
    return C.joined(found, low, ["hash"], "n").where("node <> b").select(F.col("node").alias("a"), "b")


def verified_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs of exact Jaccard similarity of ``similarity`` at least that join all such pairs: none inside what others joined.

    Hashes in order of frequency, rare ones first: similar sets share one of their first, so only these are looked up.
    """
    size = [len(x) for x in sets]
    _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    ranks = [np.sort(x) for x in np.split(rank[at], np.cumsum(size)[:-1])]
    places: dict[int, list[int]] = {}
    group = [{i} for i in range(len(sets))]
    out = []
    for i, own in enumerate(ranks):
        near: set[int] = set()
        for k in own[: _head(size[i], similarity)].tolist():
            near.update(places.setdefault(k, []))
            places[k].append(i)
        while near:
            j = near.pop()
            if min(size[i], size[j]) < similarity * max(size[i], size[j]) - 1e-9:
                continue
            both = len(np.intersect1d(own, ranks[j], assume_unique=True))
            if both / (size[i] + size[j] - both) >= similarity:
                out.append((i, j))
                small, large = sorted((group[i], group[j]), key=len)
                large |= small
                for m in small:
                    group[m] = large
                near -= large
    return out


#: Bytes of shingle sets that one task compares at a time; larger groups of candidates are cut into blocks that meet in pairs.
GROUP_BYTES = 16 << 20


def _verified(sets: DataFrame, near: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links inside components. sets: (s1, s2, shingles), a text perhaps repeated; near: (component, node, s1, s2, n)."""
    size = near.groupBy("component").agg(F.ceil(F.sum("n") * 8 / GROUP_BYTES).cast("int").alias("blocks"), F.count("*").alias("members"))
    large = C.stored(size.where("blocks > 1"), "near-large")
    dealt = C.joined(near, large, ["component"], "members", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    dealt = dealt.select("component", "node", "s1", "s2", block.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    members = dealt.join(sets, ["s1", "s2"]).select("component", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "node", "shingles")
    group = ["component", "lo", "hi"]
    dealt = members.repartition(C.partitions(near.sparkSession), *group).sortWithinPartitions(*group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        last = None

        def found() -> pa.RecordBatch:
            node = np.array(list(held), np.int64)
            pairs = np.array(verified_links(list(held.values()), similarity), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(node[pairs[:, 0]]), pa.array(node[pairs[:, 1]])], ["a", "b"])

        for b in batches:
            for *group, node, x in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True):
                if group != last and held:
                    yield found()
                    held = {}
                last = group
                held[node] = np.frombuffer(x, np.uint64)
        if held:
            yield found()

    return C.mapped(dealt, run, "a long, b long")


def _text_ids(b: pa.RecordBatch) -> tuple[list[bytes], np.ndarray]:
    """Texts of a batch, and their 128-bit digests as (n, 2)."""
    texts = list(C.texts_of(b, "text"))
    return texts, np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, texts)), np.uint64).reshape(-1, 2)


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row, that of the smallest id, of each group linked by near copies; ties go to the smaller text digest."""
    spark = docs.sparkSession
    rows = C.keyed(docs, id_col, text_col).select("did", "text")
    few = int(np.ceil(FEW / similarity)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ids = _text_ids(b)
            sets = [np.unique(shingle_hashes(t.lower().split(), shingle)) for t in texts]
            wide = [wide_fingerprint(x, WORDS) for x in sets]
            first = np.array([w[0] for w in wide], np.uint64)
            heads = [x[: _head(len(x), similarity)].tobytes() if len(x) < few else None for x in sets]
            rep = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), C.signed(ids[:, 0]), C.signed(ids[:, 1]), C.signed(first), pa.array([w.tobytes() for w in wide], pa.binary()), pa.array(rep, pa.binary()), pa.array(heads, pa.binary()), pa.array([len(x) for x in sets], pa.int64())],
                ["did", "s1", "s2", "fp", "wide", "rep", "heads", "n"],
            )

    with C.cleaned(spark, "near-lost"):
        prints = C.stored(C.mapped(rows, run, "did long, s1 long, s2 long, fp long, wide binary, rep binary, heads binary, n long"), "wide-prints")
        # equal shingle sets are one node
        nodes = prints.groupBy("fp", "wide", "rep").agg(F.min(F.struct("did", "s1", "s2")).alias("low"), F.first("heads").alias("heads"), F.first("n").alias("n"))
        nodes = C.stored(nodes.drop("rep").withColumn("node", F.monotonically_increasing_id()), "wide-nodes")
        close = links(nodes.select("fp", F.col("node").alias("rep"), "wide", size_class(F.col("n"), similarity).alias("class")), reach_of(similarity, 64, FIRST_SPREAD), (reach_of(similarity, 128, SPREAD), reach_of(similarity, 64 * WORDS, SPREAD)))
        found = C.connected_components(close.union(_few_links(nodes)), "near-candidates")
        found = found.select("node", "component").union(found.select("component", "component")).distinct()
        near = C.stored(found.join(nodes, "node").select("component", "node", "low.s1", "low.s2", "n"), "near-members")
        members = spark.sparkContext.broadcast(C.bit_filter(near.select("s1"), "s1"))

        def set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()  # a task sends one of the copies of a text
            for b in batches:
                texts, ids = _text_ids(b)
                flag = C.in_filter(members.value, ids[:, 0])
                at = []
                for i in np.flatnonzero(flag).tolist():
                    own = int(ids[i, 0]) << 64 | int(ids[i, 1])
                    if own not in seen:
                        seen.add(own)
                        at.append(i)
                sets = [np.unique(shingle_hashes(texts[i].lower().split(), shingle)).tobytes() for i in at]
                yield pa.RecordBatch.from_arrays([C.signed(ids[at, 0]), C.signed(ids[at, 1]), pa.array(sets, pa.binary())], ["s1", "s2", "shingles"])

        sets = C.mapped(rows.select("text"), set_rows, "s1 long, s2 long, shingles binary")
        found = C.connected_components(C.stored(_verified(sets, near, similarity), "near-links"), "near-copies")
        classes = nodes.join(found, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("low").alias("low"))
        kept = classes.select("low.did", "low.s1", "low.s2", F.lit(True).alias("kept"))
        # rows that go, and rows that stand twice; all others need no decision
        lost = prints.groupBy("did", "s1", "s2").agg(F.count("*").alias("n")).join(kept, ["did", "s1", "s2"], "left").where("kept is null or n > 1")
        lost = C.stored(lost.select("did", "s1", "s2", "kept"), "near-lost")
    doubtful = spark.sparkContext.broadcast(C.bit_filter(lost.select("s1"), "s1"))
    packed = docs.select(C.whole_row(docs).alias("row"))
    at = docs.columns.index(text_col)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = _text_ids(pa.RecordBatch.from_arrays([b.column(0).field(at)], ["text"]))[1]
            doubt = C.in_filter(doubtful.value, ids[:, 0])
            yield pa.RecordBatch.from_arrays([C.signed(ids[:, 0]), C.signed(ids[:, 1]), pa.array(doubt), b.column(0)], ["s1", "s2", "doubt", "row"])

    sifted = C.stored(C.mapped(packed, sift, C.fields("s1 long, s2 long, doubt boolean", ("row", packed.schema["row"].dataType))), "near-sifted")
    did = F.coalesce(F.col("row")[id_col].cast("long"), F.lit(C.NULL_ID))
    decided = sifted.where("doubt").withColumn("did", did).join(lost.withColumn("listed", F.lit(True)), ["did", "s1", "s2"], "left").where("listed is null or kept")
    once = decided.where("listed is null").select("row").unionByName(decided.where("listed").dropDuplicates(["did", "s1", "s2"]).select("row"))
    return sifted.where("not doubt").select("row").unionByName(once).select("row.*")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(fingerprints(C.table(spark, sf_dir, "documents"), shingle=3), radius=3)
    return found.select(C.plain_id().alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), C.plain_id("component").alias("component_id"))
