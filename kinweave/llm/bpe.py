"""BPE encoding and decoding by a tokenization automaton.

The automaton's arcs carry tokens; it accepts exactly the token sequences that merging in order would give. It
starts as one state with an arc for each byte. The gadget of rule (u, v) -> uv, applied in the order of the
rules, adds an arc uv from each state with an arc u, into the state behind v; and forks the state behind u,
whose copy has no arc v. So the state behind an arc depends on its token alone, and arc t leaves state s unless a
gadget made the same boundary impossible. The table of 10^9 arcs is not written out: gadgets are compiled into
birth and death times, and a row's cells are filled from these when a word first asks for them.

One path only spells each prefix of a word, so encoding is a walk over arcs that never tries a place twice.
Decoding emits the bytes on the arcs.

Null text encodes as empty. Strings of added tokens inside texts become those tokens, as the file asks.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .pieces import MEMO_PIECES, Pieces, byte_of_char, shipped

VOCABULARY = "byte_bpe_50k.json"
_TABLE_CELLS = 200_000
_HEAD = 4
_SHORT = tuple(range(_HEAD - 1, 0, -1))


class Automaton:
    """Compiled from tokens (label bytes by id) and rules (left id, right id, joined id) in order."""

    def __init__(self, labels: dict[int, bytes], rules: list[tuple[int, int, int]]):
        self.labels = labels
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.birth = dict.fromkeys(labels, -1)
        self.death: dict[tuple[int, int], int] = {}
        for time, (u, v, uv) in enumerate(rules):
            self._gadget(time, u, v, uv)
        self.table: dict[int, bool] = {}
        #: Tokens by label, without those that merging in order never makes.
        self.whole = {label: t for t, label in labels.items() if len(label) == 1}
        for t in sorted(self.left, key=self.birth.__getitem__):
            if all(self.whole.get(labels[x]) == x for x in (self.left[t], self.right[t])) and self._alive(self.left[t], self.right[t], self.birth[t]):
                self.whole[labels[t]] = t
        #: Widths of arcs, widest first, by the first _HEAD bytes of their labels; shorter ones may follow any.
        found: dict[bytes, set[int]] = {}
        for label in self.whole:
            if len(label) >= _HEAD:
                found.setdefault(label[:_HEAD], set()).add(len(label))
        self.widths = {head: (*sorted(own, reverse=True), *_SHORT) for head, own in found.items()}

    def _gadget(self, time: int, u: int, v: int, uv: int) -> None:
        self.death.setdefault((u, v), time)  # arc v behind u ends now
        if uv not in self.left:
            self.left[uv], self.right[uv], self.birth[uv] = u, v, time  # arcs uv begin now

    def arc(self, s: int, t: int) -> bool:
        """Does arc t leave the state behind s?"""
        cell = s << 20 | t
        if (found := self.table.get(cell)) is None:
            found = self._alive(s, t)
            if len(self.table) >= _TABLE_CELLS:
                self.table.clear()
            self.table[cell] = found
        return found

    def _alive(self, s: int, t: int, now: int = 1 << 60) -> bool:
        # backwards in time: what stood left and right of the boundary, and until when it stood there
        until_s = until_t = now
        while True:
            end = self.death.get((s, t))
            if end is not None and end < now and end < until_s and end <= until_t:  # at one time the leftmost pair merges first
                return False
            if s not in self.left and t not in self.left:
                return True
            if self.birth[s] > self.birth[t]:
                until_s, s = self.birth[s], self.right[s]
            else:
                until_t, t = self.birth[t], self.left[t]

    def encode(self, word: bytes) -> list[int]:
        """The one path that spells the word: longest arcs first, stepping back where no arc goes on."""
        if (t := self.whole.get(word)) is not None:
            return [t]
        n, at = len(word), 0
        widths, labels, table = self.widths.get, self.whole.get, self.table.get
        path: list[int] = []
        taken: list[tuple[int, tuple[int, ...], int]] = []  # of each arc: its width, the widths at its start, how many were tried
        closed = bytearray(n + 1)  # one path reaches each place, so a place that led nowhere once leads nowhere
        own, k = widths(word[:_HEAD], _SHORT), 0
        while at < n:
            t = None
            while k < len(own):
                end = at + own[k]
                k += 1
                if end > n or closed[end] or (t := labels(word[at:end])) is None:
                    continue
                if not path:
                    break
                if (ok := table(path[-1] << 20 | t)) is None:
                    ok = self.arc(path[-1], t)
                if ok:
                    break
                t = None
            if t is not None:
                path.append(t)
                taken.append((end - at, own, k))
                at = end
                own, k = widths(word[at : at + _HEAD], _SHORT), 0
            else:
                closed[at] = 1
                path.pop()
                width, own, k = taken.pop()
                at -= width
        return path


class Coder:
    """Encoding and decoding with one vocabulary, the bytes of its JSON file."""

    def __init__(self, data: bytes, memo: int = MEMO_PIECES):
        spec = json.loads(data)
        chars, model = byte_of_char(), spec["model"]
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        vocab = {k: v for k, v in model["vocab"].items() if k not in self.added}
        labels = {i: bytes(chars[c] for c in k) for k, i in vocab.items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = Automaton(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.labels = labels | {i: k.encode() for k, i in self.added.items()}
        self.label_of = np.empty(max(self.labels) + 1, object)
        for i, label in self.labels.items():
            self.label_of[i] = label
        self.pieces = Pieces(self.added, lambda w: np.array(self.automaton.encode(w.encode()), np.int32).tobytes(), memo)

    def encode(self, text: str) -> np.ndarray:
        return self.pieces.ids(text)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(self.label_of[ids].tolist()).decode("utf-8", "replace")


@lru_cache(2)
def coder(data: bytes, memo: int = MEMO_PIECES) -> Coder:
    """One for all tasks of a worker, so its memo lasts."""
    return Coder(data, memo)


def ids_array(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32), pa.int32()))


def id_lists(column: pa.ListArray) -> list[np.ndarray]:
    """The ids of each row; none for null."""
    flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:z] for a, z in zip(at[:-1], at[1:], strict=True)]


_DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


class _Digests:
    """n_tokens, SHA-256 of the ids joined by commas, and SHA-256 of the text they decode to."""

    def __init__(self, c: Coder):
        self.coder, self.name = c, np.array([str(i) for i in range(len(c.label_of))], object)

    def columns(self, ids: list[np.ndarray]) -> list[pa.Array]:
        said = [hashlib.sha256(",".join(self.name[x].tolist()).encode()).hexdigest() for x in ids]
        back = [hashlib.sha256(self.coder.decode(x).encode()).hexdigest() for x in ids]
        return [pa.array(list(map(len, ids)), pa.int64()), pa.array(said, pa.string()), pa.array(back, pa.string())]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, memo: int = MEMO_PIECES) -> DataFrame:
    """(did, rest, ids array<int>); with ``digest`` the ids are decoded again in the same pass, and the digests of both added.

    ``memo``: pieces that a worker keeps the ids of, for as long as it lives, some 200 bytes each.
    """
    rows, data = C.keyed(docs, id_col, text_col), shipped(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(data.value, memo)
        d = _Digests(c)
        for b in batches:
            ids = [c.encode(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            more = d.columns(ids) if digest else []
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(b.schema.get_field_index("rest")), ids_array(ids), *more], ["did", "rest", "ids", "n_tokens", "ids_sha256", "decoded_sha256"][: 3 + len(more)])

    return C.mapped(rows, run, C.fields("did long", ("rest", rows.schema["rest"].dataType), "ids array<int>" + (f", {_DIGESTS}" if digest else "")))


def decode(encoded: DataFrame, path: str, digest: bool = False) -> DataFrame:
    """The columns of ``encoded`` but its ids, with the text they spell; with ``digest``, the digests instead."""
    kept, data = [c for c in encoded.columns if c != "ids"], shipped(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(data.value)
        d = _Digests(c)
        for b in batches:
            ids = id_lists(b.column(b.schema.get_field_index("ids")))
            own = [b.column(b.schema.get_field_index(k)) for k in kept]
            if digest:
                yield pa.RecordBatch.from_arrays([*own, *d.columns(ids)], [*kept, "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([*own, pa.array([c.decode(x) for x in ids], pa.string())], [*kept, "text"])

    return C.mapped(encoded, run, C.fields(*[(c, encoded.schema[c].dataType) for c in kept], _DIGESTS if digest else "text string"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path(VOCABULARY)
    found = encode(C.table(spark, sf_dir, "documents").select("doc_id", "text"), path, digest=True)
    return found.select(C.plain_id().alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")
