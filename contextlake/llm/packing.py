"""Best-fit packing of tokenised documents into fixed-length sequences.

Tokenising: a text is cut before every space that precedes a visible ASCII
character or a letter; the tokenizer's own pattern always cuts there, so the
ids of the parts joined are the ids of the text.  Equal parts are encoded once
per block and kept in a bounded cache until the task ends, which makes the cost
follow the number of distinct parts.

Packing: bounded-space online best-fit.  A fixed number of bins is open, held
in a bitset keyed by free space: one shift and one lowest-bit look-up find the
fullest bin that a piece fits.  Where a new bin would exceed the number, the
fullest open bin closes first.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import cache, partial
from itertools import pairwise, repeat
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextlake.llm import scratch, textbuf

#: Longest part that is kept in the cache, in bytes, and the number of parts kept.
CACHED_BYTES = 48
CACHED_PARTS = 40_000
PIECES_PER_TASK = 1 << 16
#: Bytes of text encoded at once; ids are the same at any size.
BLOCK = 1 << 19

#: The vocabulary's pattern, and a private character between parts.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MARK = "\ue000"

_visible = np.zeros(256, dtype=bool)
_visible[0x21:0x7F] = True
_visible[0xC3:0xF5] = True
_visible[[0xE1, 0xE2, 0xE3]] = False  # lead bytes of Unicode spaces, as 0xC2 is


class Encoder:
    """Token ids of all texts of a block, by the ``tokenizers`` file at ``path``.

    Where the same vocabulary lies beside it as ranks (``.tiktoken``), parts are
    merged by that faster library; otherwise, or where an added token strips or
    looks around itself, whole texts go through ``tokenizers``.  The file's added
    tokens are found in the texts first, leftmost and longest, and have their own
    ids; what stands between them is encoded as texts of its own.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            added = json.load(f).get("added_tokens", [])
        self.whole = None
        ranks_path = path.removesuffix(".json") + ".tiktoken"
        if not os.path.exists(ranks_path) or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(path)
            return
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.added = {t["content"].encode(): int(t["id"]) for t in added}
        self.find = re.compile(b"|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) or rb"(?!)")
        self.mark_id = max([*ranks.values(), *self.added.values()]) + 1
        self.bpe = tiktoken.Encoding("parts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={MARK: self.mark_id})
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)

    def _encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts, number of each part's)."""
        text = MARK.join(parts)
        if text.count(MARK) != len(parts) - 1:  # the mark stands in a text
            each = [self.bpe.encode_ordinary(p) for p in parts]
            return np.array([i for ids in each for i in ids], np.uint32), np.array([len(ids) for ids in each], np.int64)
        ids = self.bpe.encode_to_numpy(text, allowed_special={MARK})
        marks = np.flatnonzero(ids == self.mark_id)
        return ids[ids != self.mark_id], np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1

    def _add(self, parts: list[str]) -> None:
        ids, length = self._encode(parts)
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(length) - length])
        self.ids = np.concatenate([self.ids, ids])
        first = len(self.length)
        self.length = np.concatenate([self.length, length])
        self.slot.update((p, first + i) for i, p in enumerate(parts) if len(p) <= CACHED_BYTES)

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, offsets of rows in them)."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if self.whole is not None:
            text = data.tobytes()
            rows = self.whole.encode_batch([text[a:b].decode() for a, b in pairwise(offsets.tolist())], add_special_tokens=False)
            return np.array([i for r in rows for i in r.ids], np.uint32), np.concatenate([[0], np.cumsum([len(r.ids) for r in rows])]).astype(np.int64)
        text = data.tobytes()
        if not self.find.search(text):
            return self._sections(data, offsets)
        found = [m for a, b in pairwise(offsets.tolist()) for m in self.find.finditer(text, a, b)]
        edges = np.unique(np.concatenate([offsets, [e for m in found for e in m.span()]]).astype(np.int64))
        ids, ends = self._sections(data, edges)
        at = np.searchsorted(edges, [m.start() for m in found])  # sections that are added tokens
        length = np.diff(ends)
        own = dict(zip(at.tolist(), (self.added[m[0]] for m in found), strict=True))
        parts = [np.array([own[i]], np.uint32) if i in own else ids[ends[i] : ends[i + 1]] for i in range(len(edges) - 1)]
        length[at] = 1
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(length)])[np.searchsorted(edges, offsets)]

    def _sections(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``block`` of texts without added tokens."""
        if len(self.slot) > CACHED_PARTS:
            self.clear()
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[: len(data) - 1] = (data[:-1] == 0x20) & _visible[data[1:]]
        cut[offsets] = True
        edges = np.flatnonzero(cut)
        parts = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data))
        coded = parts.dictionary_encode()
        names = coded.dictionary.to_pylist()
        where = np.fromiter(map(self.slot.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(where < 0)
        if len(new):
            where[new] = len(self.length) + np.arange(len(new))
            self._add([names[i] for i in new.tolist()])
        slots = where[coded.indices.to_numpy()]
        length = self.length[slots]
        ends = np.cumsum(length)
        total = int(ends[-1])
        at = np.arange(total) + np.repeat(self.start[slots] - (ends - length), length)
        row_ends = np.concatenate([[0], ends])[np.searchsorted(edges, offsets)]
        return self.ids[at], row_ends


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut_points(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``total`` ids: only the first may be shorter."""
    head = total % capacity
    out = [(0, head)] if head else []
    return out + [(s, capacity) for s in range(head, total, capacity)]


def _tokenised(batches: Iterable[pa.RecordBatch], path: str, end_id: int, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    end = np.array([end_id], "<u4")
    try:
        for batch in batches:
            for i, _, data, offsets in textbuf.blocks(batch.column(1), BLOCK):
                ids, rows = enc.block(data, offsets)
                ids = ids.astype("<u4", copy=False)
                out: dict[str, list[Any]] = {"at": [], "piece": [], "start": [], "length": [], "ids_crc32": [], "ids": []}
                for r in range(len(offsets) - 1):
                    own = np.concatenate([ids[rows[r] : rows[r + 1]], end])
                    for p, (start, length) in enumerate(cut_points(len(own), capacity)):
                        part = own[start : start + length]
                        for k, v in zip(out, (i + r, p, start, length, zlib.crc32(part.tobytes()), part if with_ids else None), strict=True):
                            out[k].append(v)
                columns = [batch.column(0).take(pa.array(out["at"], pa.int64())), pa.array(out["piece"], pa.int32())] + [pa.array(out[k], pa.int64()) for k in ("start", "length", "ids_crc32")]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int64) for x in out["ids"]], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
    finally:  # the worker lives on
        enc.clear()
        textbuf.trim()


class Bins:
    """Open bins in a bitset keyed by free space."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = 0
        self.open = 0
        self.next = 0

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        number = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece of this length."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, number = self.capacity, self.next
            self.next += 1
        left = free - length
        if left:
            self.by_free[left].append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.capacity - free


def _packed(batches: Iterable[pa.RecordBatch], capacity: int, open_bins: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    context = TaskContext.get()
    first = (context.partitionId() if context else 0) << 40
    bins = Bins(capacity, open_bins)
    for batch in batches:
        places = [bins.place(x) for x in batch.column("length").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([first + b for b, _ in places], pa.int64()), pa.array([o for _, o in places], pa.int64())],
            [*batch.schema.names, "sequence_id", "offset"],
        )


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every document.

    A null text is empty and so is the end id alone; rows that repeat an id are
    documents of their own; a null id stays null; other columns are ignored.
    """
    schema = "id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return textbuf.mapped(texts, partial(_tokenised, path=path, end_id=end_id, capacity=capacity, with_ids=with_ids), schema)


def pack(items: DataFrame, capacity: int = 1024, open_bins: int = 1024, key: tuple[str, ...] = ("id", "piece")) -> DataFrame:
    """``items`` with sequence_id and offset; ``length`` must be 1 to ``capacity``.

    Each task packs about ``PIECES_PER_TASK`` pieces by itself, in the order of
    a hash; measured, that order wastes less than orders by length do with
    bounded bins (0.9 % above the sum of lengths).  Sequence numbers are unique,
    not dense.
    """
    spark = items.sparkSession
    items = scratch.table(items, "pieces")
    tasks = max(1, -(-items.count() // PIECES_PER_TASK))
    mixed = F.xxhash64(*key, "ids_crc32")
    dealt = items.repartition(tasks, mixed).sortWithinPartitions(F.xxhash64(mixed, F.lit(1)), *key, "length")
    schema = spark.createDataFrame([], items.schema).schema.add("sequence_id", "long").add("offset", "long")
    return textbuf.mapped(dealt, partial(_packed, capacity=capacity, open_bins=open_bins), schema)


def packed_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, capacity: int = 1024, open_bins: int = 1024, with_ids: bool = False) -> DataFrame:
    """Tokenise and pack: one row per piece, an empty table for no documents."""
    return pack(pieces(docs, path, id_col, text_col, end_id, capacity, with_ids), capacity, open_bins).withColumnRenamed("id", id_col)
