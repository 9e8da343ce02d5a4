"""Byte-level BPE with forced boundaries, and its decoding."""

from __future__ import annotations

import heapq
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from renewlake.llm.common import prepared, texts_of

# The split pattern of this tokenizer family (fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

CACHED_PIECES = 100_000
WIDE = 48  # bytes of a fragment beyond which merging goes through a heap
FAST_END = 0x250  # code points below are split by the quicker standard pattern
NO_MERGE = np.iinfo(np.int32).max


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself if printable in Latin-1, else the next code point from 256."""
    visible = [b for lo, hi in ((33, 127), (161, 173), (174, 256)) for b in range(lo, hi)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in set(visible) else chr(next(hidden)) for b in range(256)]


def _class_below(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(FAST_END) if regex.fullmatch(kind, chr(c)))


class ByteBPE:
    """Encoder and decoder for one vocabulary file (the JSON of the tokenizers library)."""

    def __init__(self, spec: dict):
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        alphabet = byte_alphabet()
        byte_of = {c: b for b, c in enumerate(alphabet)}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items() if t not in self.added}
        self.bytes_of.update({i: t.encode() for t, i in self.added.items()})
        self.single = np.array([vocab[c] for c in alphabet], np.int32)
        self.split_added = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None

        # Byte pairs inside some token; a merge can never span any other pair.
        joined = np.zeros((256, 256), bool)
        for token in self.bytes_of.values():
            pair = np.frombuffer(token, np.uint8)
            joined[pair[:-1], pair[1:]] = True
        self.forced = (~joined).ravel()

        # Merge table: pair of ids -> rank and new id, in an open hash for vectorised look-up.
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.new_id = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.rank = {(int(a), int(b)): r for r, (a, b) in enumerate(zip(left, right))}
        keys = left << 20 | right
        self.bits = max(4, int(len(keys) * 8).bit_length())
        self.slot_key = np.full(1 << self.bits, -1, np.int64)
        self.slot_rank = np.full(1 << self.bits, NO_MERGE, np.int32)
        self.probes = 1
        todo, step = np.arange(len(keys)), 0
        while len(todo):
            at = (self._slot(keys[todo]) + step) & ((1 << self.bits) - 1)
            free = self.slot_key[at] < 0
            self.slot_key[at[free]] = keys[todo[free]]  # of several for one slot the last stays
            won = free & (self.slot_key[at] == keys[todo])
            self.slot_rank[at[won]] = todo[won]
            todo, step = todo[~won], step + 1
        self.probes = max(1, step)

        letters, numbers, spaces = (_class_below(k) for k in (r"\p{L}", r"\p{N}", r"\s"))
        self.fast = re.compile(
            rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+"
            rf"|[{spaces}]+(?![^{spaces}])|[{spaces}]+").findall
        self.is_fast = re.compile(f"[\x00-{chr(FAST_END - 1)}]*").fullmatch
        self.full = regex.compile(PIECES).findall
        self.cache: dict[str, bytes] = {}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 20 | right
        at = self._slot(keys)
        out = np.full(keys.shape, NO_MERGE, np.int32)
        for step in range(self.probes):
            hit = (at + step) & ((1 << self.bits) - 1)
            same = self.slot_key[hit] == keys
            out[same] = self.slot_rank[hit[same]]
        return out

    def _merge_same_length(self, ids: np.ndarray) -> list[bytes]:
        """Merge fragments of one length, all at once: each round merges the best pair of every fragment."""
        out: list[bytes] = [b""] * len(ids)

        def finish(rows: np.ndarray, final: np.ndarray) -> None:
            size, data = 4 * final.shape[1], final.tobytes()
            for k, row in enumerate(rows.tolist()):
                out[row] = data[k * size: (k + 1) * size]

        rows = np.arange(len(ids))
        if ids.shape[1] == 1:
            finish(rows, ids)
            return out
        ranks = self._ranks(ids[:, :-1], ids[:, 1:])
        while True:
            best = ranks.argmin(1)
            least = ranks[np.arange(len(rows)), best]
            done = least == NO_MERGE
            if done.any():
                finish(rows[done], ids[done])
                rows, ids, ranks, best, least = rows[~done], ids[~done], ranks[~done], best[~done], least[~done]
            if not len(rows):
                return out
            width = ids.shape[1]
            each = np.arange(len(rows))
            ids[each, best] = self.new_id[least]
            stay = np.ones(ids.shape, bool)
            stay[each, best + 1] = False
            ids = ids[stay].reshape(len(rows), width - 1)
            if width == 2:
                finish(rows, ids)
                return out
            stay = np.ones(ranks.shape, bool)
            stay[each, best] = False
            ranks = ranks[stay].reshape(len(rows), width - 2)
            inner = best < width - 2
            at = best[inner]
            ranks[each[inner], at] = self._ranks(ids[each[inner], at], ids[each[inner], at + 1])
            inner = best > 0
            at = best[inner]
            ranks[each[inner], at - 1] = self._ranks(ids[each[inner], at - 1], ids[each[inner], at])

    def _merge_wide(self, fragment: bytes) -> bytes:
        """Merge one long fragment with a heap: n log n, however long it is."""
        ids = self.single[np.frombuffer(fragment, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := self.rank.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two is gone
            ids[i], ids[j] = int(self.new_id[r]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := self.rank.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return np.array([i for i in ids if i >= 0], np.int32).tobytes()

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece (as int32 bytes): cut where the byte pair forces it, merge the fragments, concatenate."""
        raw = [p.encode() for p in pieces]
        flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.int32)
        ends = np.cumsum([len(b) for b in raw])
        cut = np.zeros(len(flat) + 1, bool)
        cut[1:-1] = self.forced[flat[:-1] * 256 + flat[1:]]
        cut[ends] = cut[0] = True
        bounds = np.flatnonzero(cut)
        starts, lengths = bounds[:-1], np.diff(bounds)
        merged: list[bytes] = [b""] * len(starts)
        for length in np.unique(lengths).tolist():
            these = np.flatnonzero(lengths == length)
            if length > WIDE:
                for k in these.tolist():
                    merged[k] = self._merge_wide(flat[starts[k]: starts[k] + length].astype(np.uint8).tobytes())
            else:
                block = self.single[flat[starts[these][:, None] + np.arange(length)[None, :]]]
                for k, ids in zip(these.tolist(), self._merge_same_length(block)):
                    merged[k] = ids
        first = np.searchsorted(bounds, np.concatenate([[0], ends])).tolist()
        return [merged[a] if b == a + 1 else b"".join(merged[a:b]) for a, b in zip(first, first[1:])]

    def pieces(self, text: str) -> list[str]:
        return (self.fast if self.is_fast(text) else self.full)(text)

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, as int32 arrays."""
        cut = [p for t in texts for p in self._parts(t or "")]
        if len(self.cache) > CACHED_PIECES:
            self.cache.clear()
        split = [[] if special else self.pieces(part) for _, part, special in cut]
        new = list(set(chain.from_iterable(split)).difference(self.cache))
        if new:
            self.cache.update(zip(new, self._encode_pieces(new)))
        look = self.cache.__getitem__
        out: list[list[bytes]] = []
        for (starts, part, special), pieces in zip(cut, split):
            if starts:
                out.append([])
            out[-1].append(np.int32(self.added[part]).tobytes() if special else b"".join(map(look, pieces)))
        return [np.frombuffer(b"".join(parts), np.int32) for parts in out]

    def _parts(self, text: str) -> list[tuple[bool, str, bool]]:
        """(does a text start here, part, is it an added token) in order."""
        if self.split_added is None or not any(t in text for t in self.added):
            return [(True, text, False)]
        return [(i == 0, part, i % 2 == 1) for i, part in enumerate(self.split_added.split(text))]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


def _spec(spark: SparkSession, vocabulary: str):
    """The vocabulary file, read by the driver and sent to each executor once; its size is the tokenizer's own."""
    with open(vocabulary, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(json.load(file))


def _id_lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values)))


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
           decoded: bool = False) -> DataFrame:
    """(doc_id, ids[, decoded]): the token ids of every whole text, and the text decoded from them.

    The text is split by the tokenizer's pattern; within a piece, a byte pair that no token
    of the vocabulary has inside is a certain cut, so the fragments between are merged on
    their own and their ids joined. Strings of added tokens become their ids. `decoded`
    comes from the ids alone, added tokens included.

    Defined cases: a null or empty text has no ids and decodes to ''; repeated rows and
    null ids stay as they are; an empty table gives an empty table; further columns are ignored.
    """
    spark = prepared(docs.sparkSession)
    spec = _spec(spark, vocabulary)

    def run(batches):
        bpe = ByteBPE(spec.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if not texts:
                continue
            ids = bpe.encode_batch(texts)
            columns = {"doc_id": batch.column(0), "ids": _id_lists(ids)}
            if decoded:
                columns["decoded"] = pa.array([bpe.decode(i) for i in ids], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return texts_of(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, ids array<int>" + (", decoded string" if decoded else ""))


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from (doc_id, ids). Null ids decode to ''; an id outside the vocabulary is an error."""
    spark = prepared(encoded.sparkSession)
    spec = _spec(spark, vocabulary)

    def run(batches):
        bpe = ByteBPE(spec.value)
        for batch in batches:
            texts = [bpe.decode(np.array(ids or [], np.int32)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": pa.array(texts, pa.string())})

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")
                          ).mapInArrow(run, "doc_id long, text string")
