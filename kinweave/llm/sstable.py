"""Token ids in sorted-string-table shards, for lookup of documents by identifier.

A shard is a file of data blocks, a sparse index, a Bloom filter and a footer:

* block: entries in key order, zstd-compressed. Entry: varint shared key bytes, varint own key bytes, varint value
  length, own key bytes, value. The key is shared in whole at every ``RESTART``-th entry; the offsets of those
  entries and their number (u32 each) end the block, for binary search;
* key: identifier + 2**63 as 8 bytes, big-endian, then 4 bytes counting rows of one identifier;
* value: a byte 2 or 4, then the ids as little-endian integers of that width;
* index: for each block varint length of its last key, the key, varint offset, length and raw length of the block;
* Bloom filter: ``BLOOM_BITS`` bits an identifier, ``BLOOM_HASHES`` places each by double hashing of XXH3-128;
* footer: offsets and lengths of index and filter, documents, ids (six u64) and the magic bytes.

Identifiers ascend inside a shard and from shard to shard; a shard is closed at ``SHARD_BYTES`` of ids, so what a task
holds for it (identifiers, index, filter) does not grow with the table. Null identifiers sort last. Rows of one
identifier are all kept, ordered by text hash, and may be spread over several shards and tasks. Null text has the end id
only. Other columns are left out. An empty table makes shards without documents.
"""

from __future__ import annotations

import os
import re
import string
import struct
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .files import published, reader
from .pieces import shipped

MAGIC = b"KWSSTAB1"
BLOCK_BYTES, RESTART, BLOOM_BITS, BLOOM_HASHES = 1 << 16, 16, 10, 7
SHARD_BYTES = 1 << 28
END_ID = 0
_FOOTER = struct.Struct("<6Q8s")


# --- encoding with the library -------------------------------------------------------------------


_TAIL = string.punctuation
#: A space before white space or at the end: such texts are not cut at spaces.
_UNEVEN = re.compile(r" (?:\s|\Z)")
MEMO_WORDS, _ROW = 1_100_000, 500


class LibraryCoder:
    """The tokenizers library behind a memo of pieces between spaces.

    A piece that starts with a space and has no white space after it is cut off there by byte-level pre-splitting
    whatever surrounds it, so its ids can be kept; and a word of Latin letters is cut from the ASCII punctuation that
    ends it, so the two are kept apart and each word is encoded once with whatever follows it. Texts in which a space
    stands before white space or at an end, or that hold an added token, are given to the library in whole.
    """

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_buffer(data)
        self.tool.no_truncation()
        self.tool.no_padding()
        self.added = [t.content for t in self.tool.get_added_tokens_decoder().values()]
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        blank = self.tool.encode(" ", add_special_tokens=False).tokens[0][0]
        vocab = self.tool.get_vocab()
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        self.opens[[i for t, i in vocab.items() if t.startswith(blank)]] = True

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece with a blank in front: encoded in rows, and parted where a token opens with the blank."""
        out: list[bytes] = []
        groups = [pieces[i : i + _ROW] for i in range(0, len(pieces), _ROW)]
        for own, e in zip(groups, self.tool.encode_batch([" " + " ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = array("i", e.ids)
            at = np.flatnonzero(self.opens[np.frombuffer(ids, np.int32)])
            if len(at) != len(own) or at[0]:
                out += self._whole([" " + p for p in own])
                continue
            data, cut = ids.tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
            out += [data[a:z] for a, z in zip(cut[:-1], cut[1:], strict=True)]
        return out

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("i", e.ids).tobytes() for e in self.tool.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, pieces: set[str]) -> None:
        """Put pieces into the memo; punctuation alone is keyed with a blank in front, as no piece is."""
        memo, old = self.memo, self.old
        parts, words, tails = {}, set(), set()
        for p in pieces:
            if (ids := old.get(p)) is not None:
                memo[p] = ids
            elif p[-1] in _TAIL and (word := p.rstrip(_TAIL)).isalpha() and max(word) < "\u0250":
                parts[p] = word, " " + p[len(word) :]
                words.add(word)
                tails.add(" " + p[len(word) :])
            else:
                words.add(p)
        for group, encoded in ((words, self._pieces), (tails, lambda new: self._whole([t[1:] for t in new]))):
            new = []
            for p in group:
                if p in memo:
                    continue
                if (ids := old.get(p)) is not None:
                    memo[p] = ids
                else:
                    new.append(p)
            memo.update(zip(new, encoded(new), strict=True))
        for p, (word, tail) in parts.items():
            memo[p] = memo[word] + memo[tail]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[bytes | None] = [None] * len(texts)
        cut: list[tuple[int, list[str], list[bytes | None], list[int]]] = []
        known, missing, firsts = self.memo.get, set(), []
        for i, text in enumerate(texts):
            if any(a in text for a in self.added):
                continue
            first, *pieces = text.split(" ")
            ids = list(map(known, pieces))
            gaps = [k for k, x in enumerate(ids) if x is None] if None in ids else []
            new = [pieces[k] for k in gaps]
            if pieces and not first or gaps and _UNEVEN.search(text):
                continue
            missing.update(new)
            firsts.append(first)
            cut.append((i, pieces, ids, gaps))
        self._learn(missing)
        memo = self.memo
        for (i, pieces, ids, gaps), first in zip(cut, self._whole(firsts), strict=True):
            for k in gaps:
                ids[k] = memo[pieces[k]]
            out[i] = first + b"".join(ids)
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self._whole([texts[i] for i in rest]), strict=True):
            out[i] = ids
        if len(memo) > MEMO_WORDS:
            self.old, self.memo = memo, {}
        return [np.frombuffer(x, np.int32) for x in out]


@lru_cache(1)
def library_coder(data: bytes) -> LibraryCoder:
    """One for all tasks of a worker, so its memo lasts."""
    return LibraryCoder(data)


# --- the format ----------------------------------------------------------------------------------


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def key_of(ident: int, row: int = 0) -> bytes:
    return struct.pack(">QI", ident + 2**63, row)


def _bloom_places(key8: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key8)
    a, b = h & (2**64 - 1), h >> 64 | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


def write_shard(uri: str, rows: Iterable[tuple[int, np.ndarray]], after: bytes = b"") -> tuple[int, int, bytes]:
    """Write (identifier, ids) in identifier order; numbers of documents and ids, and the last key. ``after``: the last key of the shard before."""
    index, block, restarts = bytearray(), bytearray(), []
    idents: list[int] = []
    docs = total = at = inside = 0
    last = after
    with published(uri) as f:

        def flush() -> None:
            nonlocal at, inside, block, restarts
            raw = bytes(block) + struct.pack(f"<{len(restarts)}II", *restarts, len(restarts))
            packed = pa.compress(raw, "zstd", asbytes=True)
            index.extend(_varint(len(last)) + last + _varint(at) + _varint(len(packed)) + _varint(len(raw)))
            f.write(packed)
            at += len(packed)
            block, restarts, inside = bytearray(), [], 0

        for ident, ids in rows:
            row = struct.unpack(">I", last[8:])[0] + 1 if last[:8] == key_of(ident)[:8] else 0
            key = key_of(ident, row)
            assert key > last, "identifiers have to ascend"
            width = 2 if not len(ids) or int(ids.max()) < 65536 else 4
            value = bytes([width]) + ids.astype(f"<u{width}").tobytes()
            shared = 0
            if inside % RESTART == 0:
                restarts.append(len(block))
            else:
                while key[shared] == last[shared]:
                    shared += 1
            block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
            last, inside, docs, total = key, inside + 1, docs + 1, total + len(ids)
            if not idents or idents[-1] != ident:
                idents.append(ident)
            if len(block) >= BLOCK_BYTES:
                flush()
        if inside:
            flush()
        bits = max(64, BLOOM_BITS * len(idents))
        bloom = np.zeros(-(-bits // 8), np.uint8)
        for ident in idents:
            for p in _bloom_places(key_of(ident)[:8], bits):
                bloom[p >> 3] |= 1 << (p & 7)
        tail = struct.pack("<Q", bits) + bloom.tobytes()
        f.write(bytes(index) + tail + _FOOTER.pack(at, len(index), at + len(index), len(tail), docs, total, MAGIC))
    return docs, total, last


class Shard:
    """An open shard: ``get`` looks one identifier up, ``scan`` reads all."""

    def __init__(self, uri: str):
        self.file = reader(uri)
        size = self.file.size()
        at, n, bloom_at, bloom_n, self.docs, self.total, magic = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no shard")
        self.bloom = self.file.read_at(bloom_n, bloom_at)
        data, k = self.file.read_at(n, at), 0
        self.last_keys: list[bytes] = []
        self.blocks: list[tuple[int, int, int]] = []
        while k < len(data):
            m, k = _read_varint(data, k)
            self.last_keys.append(data[k : k + m])
            k += m
            a, k = _read_varint(data, k)
            b, k = _read_varint(data, k)
            c, k = _read_varint(data, k)
            self.blocks.append((a, b, c))

    def _block(self, i: int) -> bytes:
        at, n, raw = self.blocks[i]
        return pa.decompress(self.file.read_at(n, at), raw, "zstd", asbytes=True)

    @staticmethod
    def _entries(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < end:
            shared, at = _read_varint(data, at)
            own, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            at += own
            yield key, data[at : at + n]
            at += n

    @staticmethod
    def _ids(value: bytes) -> np.ndarray:
        return np.frombuffer(value, f"<u{value[0]}", offset=1)

    def scan(self) -> Iterator[tuple[int, np.ndarray]]:
        for i in range(len(self.blocks)):
            data = self._block(i)
            n = struct.unpack_from("<I", data, len(data) - 4)[0]
            for key, value in self._entries(data, 0, len(data) - 4 - 4 * n):
                yield struct.unpack(">Q", key[:8])[0] - 2**63, self._ids(value)

    def get(self, ident: int) -> list[np.ndarray]:
        """Ids of every row of an identifier."""
        key8 = key_of(ident)[:8]
        bits = struct.unpack_from("<Q", self.bloom)[0]
        if not all(self.bloom[8 + (p >> 3)] >> (p & 7) & 1 for p in _bloom_places(key8, bits)):
            return []
        out = []
        for i in range(bisect_left(self.last_keys, key8), len(self.blocks)):
            data = self._block(i)
            n = struct.unpack_from("<I", data, len(data) - 4)[0]
            end = len(data) - 4 - 4 * n
            restarts = struct.unpack_from(f"<{n}I", data, end)
            first = max(bisect_left(restarts, key8, key=lambda r: next(self._entries(data, r, end))[0]) - 1, 0)
            for key, value in self._entries(data, restarts[first], end):
                if key[:8] > key8:
                    return out
                if key[:8] == key8:
                    out.append(self._ids(value))
        return out


# --- writing and reading tables ------------------------------------------------------------------


def write_table(docs: DataFrame, tokenizer: str, uri: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END_ID) -> list[tuple[str, int, int]]:
    """Encode and write shards in ascending identifier order; (file, documents, ids) of each, in that order."""
    spark = docs.sparkSession
    rows = C.keyed(docs, id_col, text_col).select("did", "text", F.monotonically_increasing_id().alias("nth"))
    data = shipped(spark, tokenizer)
    # a hot identifier is cut by text, and equal rows by their place
    order = ["did", F.xxhash64("text"), "nth"]
    dealt = rows.repartitionByRange(C.partitions(spark), *order).sortWithinPartitions(*order).select("did", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = library_coder(data.value)
        end = np.array([] if end_id is None else [end_id], np.int32)

        def encoded() -> Iterator[tuple[int, np.ndarray]]:
            for b in batches:
                ids = coder.encode(b.column(1).to_pylist())
                yield from ((d, np.concatenate([x, end])) for d, x in zip(b.column(0).to_pylist(), ids, strict=True))

        source = encoded()
        ahead = next(source, None)

        def shard() -> Iterator[tuple[int, np.ndarray]]:
            nonlocal ahead
            size = 0
            while ahead is not None and size < SHARD_BYTES:
                size += ahead[1].nbytes
                yield ahead
                ahead = next(source, None)

        part, n, last = TaskContext.get().partitionId(), 0, b""
        while ahead is not None or n == 0:
            name = f"{uri}/part-{part:06d}-{n:06d}.sst"
            docs_n, ids_n, last = write_shard(name, shard(), last)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([docs_n]), pa.array([ids_n])], ["name", "docs", "ids"])
            n += 1

    # a row for each shard
    with C.batch_rows(spark):
        found = C.mapped(dealt, run, "name string, docs long, ids long").collect()
    return [(r["name"], r["docs"], r["ids"]) for r in sorted(found, key=lambda r: r["name"])]


def read_table(spark: SparkSession, shards: list[tuple[str, int, int]], digest: bool = False) -> DataFrame:
    """(did, start, ids): start is the number of ids in all rows before; with ``digest`` (did, start, n_tokens, ids_crc32)."""
    base = np.cumsum([0, *[s[2] for s in shards]]).tolist()
    work = spark.sparkContext.broadcast([(name, b) for (name, _, _), b in zip(shards, base, strict=False)])

    def rows(did: list[int], start: list[int], ids: list[np.ndarray]) -> pa.RecordBatch:
        from .bpe import ids_array

        own = [pa.array(did, pa.int64()), pa.array(start, pa.int64())]
        if digest:
            return pa.RecordBatch.from_arrays([*own, pa.array(list(map(len, ids)), pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())], ["did", "start", "n_tokens", "ids_crc32"])
        return pa.RecordBatch.from_arrays([*own, ids_array([x.astype(np.int32) for x in ids])], ["did", "start", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                name, at = work.value[i]
                did, start, ids, size = [], [], [], 0
                for d, x in Shard(name).scan():
                    did.append(d)
                    start.append(at)
                    ids.append(x)
                    at += len(x)
                    size += len(x)
                    if size > 1 << 20:
                        yield rows(did, start, ids)
                        did, start, ids, size = [], [], [], 0
                yield rows(did, start, ids)

    kind = "did long, start long, n_tokens long, ids_crc32 long" if digest else "did long, start long, ids array<int>"
    return spark.range(0, len(shards), 1, max(len(shards), 1)).mapInArrow(run, kind)


def digests(spark: SparkSession, shards: list[tuple[str, int, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from shards."""
    return read_table(spark, shards, digest=True).select(C.plain_id().alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op9_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    shards = write_table(C.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), C.scratch(spark, "token-tables"))
    return digests(spark, shards)
