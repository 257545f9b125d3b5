"""Chroma audio fingerprints and their alignment.

A recording (8-bit mono samples) is cut into overlapping frames; each frame's
spectrum is folded into twelve pitch classes.  Box filters over the integral
image of these frames, two quantised bits each, pack into one 32-bit integer
per frame.  A landmark is a fingerprint whose hash is the smallest of its
neighbourhood.  Queries meet recordings that share landmarks; the histogram of
their offsets gives the alignments to try, and the bit error over the whole
overlap decides.  Queries and recordings are dealt over a grid, and whoever meets in a
cell is verified there: no pair by chance, with its prints, is ever shuffled.  Pairs with a
side of few prints need samples too: short queries are verified where those are read, and of
the others' samples only the stretch that is compared is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache, lru_cache, partial
from hashlib import sha1
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contextlake.llm import scratch, textbuf

RATE, FRAME, HOP = 8000, 256, 64
FILTERS, NEIGHBOURS = 16, 8
CUTS = (-0.15, 0.0, 0.15)
GRAY = np.array([0, 1, 3, 2], np.uint32)
#: The grid: bytes of queries' prints that a cell holds, of recordings' that pass by it, and
#: the least number of recordings' parts.  What is shuffled is recordings times parts of
#: queries, and queries times parts of recordings.
QUERY_BYTES, PART_BYTES, PARTS = 16 << 20, 64 << 20, 12
#: Equal landmarks, and prints, that are compared at once.
HITS, GATHER = 1 << 20, 1 << 20
#: Bytes of all short queries' samples that go to every task of the first pass; with more,
#: their pairs are shuffled.  0.76 MB on check_l (0.51 GB), in proportion 45 MB over 30 GB.
CLIP_BYTES = 64 << 20
HEARD = pa.list_(pa.struct([("of", pa.binary()), ("rank", pa.int64()), ("offset", pa.int64()), ("frames", pa.int64()), ("bit_error", pa.float64())]))


@cache
def _pitch() -> tuple[np.ndarray, np.ndarray]:
    """Window, and the map from spectrum bins to pitch classes."""
    fold = np.zeros((FRAME // 2 + 1, 12), np.float32)
    for b in range(2, FRAME // 2 + 1):
        fold[b, round(12 * np.log2(b * RATE / FRAME / 440.0)) % 12] = 1
    return np.hanning(FRAME).astype(np.float32), fold


def chroma(samples: np.ndarray) -> np.ndarray:
    """Pitch-class frames (n, 12), each summing to one; silent ones are flat."""
    if len(samples) < FRAME:
        return np.zeros((0, 12), np.float32)
    window, fold = _pitch()
    out = []
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    for lo in range(0, len(frames), 4096):
        x = frames[lo : lo + 4096].astype(np.float32) - 128
        out.append(np.abs(np.fft.rfft((x - x.mean(axis=1, keepdims=True)) * window, axis=1)).astype(np.float32) ** 2 @ fold)
    power = np.concatenate(out)
    total = power.sum(axis=1, keepdims=True)
    return np.where(total > 1e-3, power / np.maximum(total, 1e-3), np.float32(1 / 12)).astype(np.float32)


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch, pitches, frames) by rule: three kinds of boxes at
    spread positions and sizes."""
    return [(k % 3, k * 5 % 9, 2 + k % 3 if k % 3 else 2 + 2 * (k // 8), 2 * (1 + k % 4)) for k in range(FILTERS)]


LENGTH = max(w for *_, w in filters())


def fingerprint(frames: np.ndarray) -> np.ndarray:
    """One packed integer per place that all filters fit."""
    n = len(frames) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.cumsum(axis=0, dtype=np.float64).cumsum(axis=1)
    t = np.arange(n)

    def box(a: int, b: int, lo: int, hi: int) -> np.ndarray:
        return image[t + b, hi] - image[t + a, hi] - image[t + b, lo] + image[t + a, lo]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in filters():
        if kind == 0:  # a band against all pitches
            one, two = box(0, w, y, y + h) * 12 / h, box(0, w, 0, 12)
        elif kind == 1:  # upper against lower half of a band
            one, two = box(0, w, y, y + h // 2), box(0, w, y + h // 2, y + 2 * (h // 2))
        else:  # earlier against later half of a band
            one, two = box(0, w // 2, y, y + h), box(w // 2, w, y, y + h)
        level = np.log((one + 0.01) / (two + 0.01))
        out = (out << np.uint32(2)) | GRAY[np.searchsorted(CUTS, level)]
    return out


def landmarks(prints: np.ndarray) -> np.ndarray:
    """Places whose hash is the smallest among ``NEIGHBOURS`` in a row."""
    if not len(prints):
        return np.zeros(0, np.int64)
    h = textbuf.mix(prints.astype(np.uint64))
    w = min(NEIGHBOURS, len(h))
    windows = np.lib.stride_tricks.sliding_window_view(h, w)
    return np.unique(windows.argmin(axis=1) + np.arange(len(windows)))


def _heard(names: list[bytes], clips: list[bytes], a: Recordings, index: tuple[np.ndarray, np.ndarray], rows: list[np.ndarray], samples: list[np.ndarray], worst: float, least: int, alike: float) -> list[list[dict]]:
    """For each recording of ``least`` prints or more, the clips that it holds."""
    out: list[list[dict]] = [[] for _ in rows]
    b = Recordings(np.arange(len(rows)) + len(clips), [p.astype("<u4").tobytes() if len(p) >= least else b"" for p in rows])
    for met in _meetings(index, a, b, np.arange(len(b.prints))):
        for found in _passing(a, b, met, worst, least):
            for q, r, offset, frames, rank, error in zip(*(c.tolist() for c in found), strict=True):
                r -= len(clips)
                if likeness(np.frombuffer(clips[q], np.uint8), samples[r], offset) >= alike:
                    out[r].append({"of": names[q], "rank": rank, "offset": offset, "frames": frames, "bit_error": error})
    return out


def _printed(batches: Iterable[pa.RecordBatch], least: int, worst: float = 0.12, alike: float = 0.9, clips: list[bytes] | None = None) -> Iterator[pa.RecordBatch]:
    names, indexed = [_digest(c) for c in clips or []], _clips(tuple(clips or []))
    for batch in batches:
        known = batch.column(1).is_valid().to_pylist()
        for i, j, data, offsets in textbuf.blocks(batch.column(1)):
            samples = [data[offsets[r] : offsets[r + 1]] for r in range(j - i)]
            rows = [fingerprint(chroma(x)) for x in samples]
            equal = [sha1(p.astype("<u4").tobytes()).digest() if len(p) >= least else _digest(x.tobytes()) for p, x in zip(rows, samples, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(i, j - i),
                    pa.array([len(p) for p in rows], pa.int64()),
                    pa.array([p.astype("<u4").tobytes() for p in rows], pa.binary()),
                    pa.array([e if k else None for e, k in zip(equal, known[i:j], strict=True)], pa.binary()),
                    batch.column(2).slice(i, j - i),
                    pa.array(_heard(names, clips, *indexed, rows, samples, worst, least, alike) if clips else [[]] * (j - i), HEARD),
                ],
                ["id", "n", "prints", "d", "asked", "heard"],
            )


def bit_error(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, float]:
    """(frames, share of differing bits) where b's place ``offset`` meets a's first."""
    lo, hi = max(0, -offset), min(len(a), len(b) - offset)
    if hi <= lo:
        return 0, 1.0
    return hi - lo, float(np.bitwise_count(a[lo:hi] ^ b[lo + offset : hi + offset]).sum()) / (32 * (hi - lo))


@lru_cache(maxsize=256)
def _places(packed: bytes, every: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prints, landmark values or all in order, their places)."""
    prints = np.frombuffer(packed, "<u4")
    at = np.arange(len(prints)) if every else landmarks(prints)
    order = np.argsort(prints[at], kind="stable")
    return prints, prints[at][order], at[order]


def offsets(a: bytes, b: bytes) -> list[int]:
    """Every offset at which a landmark of a meets an equal one of b, by votes;
    prints, where one has fewer than ``NEIGHBOURS``."""
    every = min(len(a), len(b)) < 4 * NEIGHBOURS
    one, va, at = _places(a, every)
    _, vb, places = _places(b, every)
    lo, hi = np.searchsorted(vb, va, "left"), np.searchsorted(vb, va, "right")
    votes = np.zeros(len(one) + len(b) // 4, np.int64)
    for k in np.flatnonzero(hi > lo).tolist():
        votes[places[lo[k] : hi[k]] - at[k] + len(one)] += 1
    found = np.flatnonzero(votes)
    near = found - len(one)
    return near[np.lexsort((-near, np.abs(near), -votes[found]))].tolist()


def likeness(a: np.ndarray, b: np.ndarray, offset: int, moved: int = 0) -> float:
    """Largest correlation of the samples that meet within half a hop of ``offset``;
    ``moved``: samples cut off before a, less those before b."""
    best, middle = 0.0, offset * HOP + moved
    for shift in range(middle - HOP // 2, middle + HOP // 2 + 1):
        lo, hi = max(0, -shift), min(len(a), len(b) - shift)
        if hi - lo >= FRAME:
            x, y = a[lo:hi].astype(float), b[lo + shift : hi + shift].astype(float)
            x, y = x - x.mean(), y - y.mean()
            best = max(best, float(x @ y) / max(float(np.sqrt((x @ x) * (y @ y))), 1e-9))
    return best


class Recordings:
    """Prints of several recordings, end to end."""

    def __init__(self, names: np.ndarray, packed: list[bytes]):
        self.names, self.packed = names, packed
        self.n = np.array([len(p) // 4 for p in packed], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.n)])
        self.prints = np.frombuffer(b"".join(packed), "<u4")

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, at, side="right") - 1

    def every(self, brief: bool) -> np.ndarray:
        """All places of the recordings below, or not below, ``NEIGHBOURS`` prints."""
        return np.flatnonzero(np.repeat((self.n < NEIGHBOURS) == brief, self.n))

    def marks(self) -> np.ndarray:
        """The landmarks' places of the recordings of ``NEIGHBOURS`` prints or more."""
        if len(self.prints) < NEIGHBOURS:
            return np.zeros(0, np.int64)
        found = []
        for lo in range(0, len(self.prints) - NEIGHBOURS + 1, GATHER):
            part = self.prints[lo : lo + GATHER + NEIGHBOURS - 1]
            windows = np.lib.stride_tricks.sliding_window_view(textbuf.mix(part.astype(np.uint64)), NEIGHBOURS)
            at = np.arange(lo, lo + len(windows))
            inside = self.owner(at) == self.owner(at + NEIGHBOURS - 1)
            found.append(np.unique((windows.argmin(axis=1) + at)[inside]))
        return np.unique(np.concatenate(found))

    def index(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(prints in order, their places)."""
        order = np.argsort(self.prints[at], kind="stable")
        return self.prints[at[order]], at[order]


@lru_cache(maxsize=1)
def _clips(samples: tuple[bytes, ...]) -> tuple[Recordings, tuple[np.ndarray, np.ndarray]]:
    """Recordings of fewer than ``NEIGHBOURS`` prints, with all their places in order."""
    a = Recordings(np.arange(len(samples)), [fingerprint(chroma(np.frombuffer(x, np.uint8))).astype("<u4").tobytes() for x in samples])
    return a, a.index(a.every(True))


def _digest(samples: bytes) -> bytes:
    """What names a recording of few prints."""
    return sha1(b"samples" + samples).digest()


def _meetings(index: tuple[np.ndarray, np.ndarray], a: Recordings, b: Recordings, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(query, recording, offset, rank) of every offset that the places ``at`` of b
    and those in the index of a give; a pair's offsets come together, by rank."""
    values, places = index
    left = np.searchsorted(values, b.prints[at], "left")
    count = np.searchsorted(values, b.prints[at], "right") - left
    at, left, count = at[count > 0], left[count > 0], count[count > 0]
    if not len(at):
        return
    rec, ends = b.owner(at), np.cumsum(count)
    if ends[-1] > HITS and rec[0] != rec[-1]:  # fewer recordings at once
        cut = np.searchsorted(rec, rec[np.searchsorted(ends, ends[-1] // 2)]) or np.searchsorted(rec, rec[0], "right")
        yield from _meetings(index, a, b, at[:cut])
        yield from _meetings(index, a, b, at[cut:])
        return
    if ends[-1] > HITS:  # one recording: fewer queries at once
        here = np.isin(values, b.prints[at])
        values, places = values[here], places[here]
        query = a.owner(places)
        names = np.unique(query)
        if len(names) > 1:
            low = query < names[len(names) // 2]
            yield from _meetings((values[low], places[low]), a, b, at)
            yield from _meetings((values[~low], places[~low]), a, b, at)
            return
        if a.names[names[0]] != b.names[rec[0]]:
            near = np.array(offsets(a.packed[names[0]], b.packed[rec[0]]), np.int64)
            yield np.full(len(near), names[0]), np.full(len(near), rec[0]), near, np.arange(len(near))
        return
    hit = places[np.arange(ends[-1]) + np.repeat(left - (ends - count), count)]
    query, rec, at = a.owner(hit), np.repeat(rec, count), np.repeat(at, count)
    offset = (at - b.start[rec]) - (hit - a.start[query])
    other = a.names[query] != b.names[rec]
    least, width = int(a.n.max()), int(a.n.max() + b.n.max()) + 1
    keys, votes = np.unique(((query * len(b.n) + rec) * width + offset + least)[other], return_counts=True)
    pair, offset = keys // width, keys % width - least
    order = np.lexsort((-offset, np.abs(offset), -votes, pair))
    pair, offset = pair[order], offset[order]
    rank = np.arange(len(pair)) - np.searchsorted(pair, pair)
    yield pair // len(b.n), pair % len(b.n), offset, rank


def _errors(a: Recordings, b: Recordings, at_a: np.ndarray, at_b: np.ndarray, frames: np.ndarray) -> np.ndarray:
    """The share of differing bits in each stretch of ``frames`` prints."""
    differ, ends, i = np.zeros(len(frames), np.int64), np.cumsum(frames), 0
    while i < len(frames):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + GATHER, "right")))
        own = frames[i:j]
        first = np.cumsum(own) - own
        step = np.arange(int(own.sum())) - np.repeat(first, own)
        bits = np.bitwise_count(a.prints[np.repeat(at_a[i:j], own) + step] ^ b.prints[np.repeat(at_b[i:j], own) + step])
        differ[i:j] = np.add.reduceat(bits, first, dtype=np.int64)
        i = j
    return differ / (32 * frames)


def _passing(a: Recordings, b: Recordings, met: tuple[np.ndarray, ...], worst: float, least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(query_id, match_id, offset, frames, rank, bit_error) of a pair's first offset
    that passes; of all that do, where one side is short."""
    query, rec, offset, rank = met
    low = np.maximum(0, -offset)
    frames = np.minimum(a.n[query], b.n[rec] - offset) - low
    need = np.minimum(least, np.minimum(a.n[query], b.n[rec]))
    pair = query * len(b.n) + rec
    left, upto = frames >= need, 1
    while left.any():  # by rank: 1, 1, 2, 4, ... offsets of each pair that is still open
        now = np.flatnonzero(left & ((rank < upto) | (need < least)))
        left[now] = False
        if len(now):
            error = _errors(a, b, (a.start[query] + low)[now], (b.start[rec] + low + offset)[now], frames[now])
            now, error = now[error <= worst], error[error <= worst]
            first = np.isin(np.arange(len(now)), np.unique(pair[now], return_index=True)[1]) | (need[now] < least)
            now, error = now[first], error[first]
            left &= ~np.isin(pair, pair[now[need[now] == least]])
            yield a.names[query[now]], b.names[rec[now]], offset[now], frames[now], rank[now], error
        upto *= 2


def _aligned(batches: Iterable[pa.RecordBatch], worst: float, least: int, clips: bool = True) -> Iterator[pa.RecordBatch]:
    """Matches of each cell: its queries come first, then recordings pass by.  Without
    ``clips``, those of a query below ``NEIGHBOURS`` prints with longer recordings are left out."""
    cell, names, packed, a = -1, [], [], None
    for batch in batches:
        cells, query = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.diff(cells) | np.diff(query.astype(np.int64))) + 1 if len(cells) else []
        for i, j in pairwise([0, *edges, len(cells)]):
            if i == j:
                continue
            if cells[i] != cell:
                cell, names, packed, a = cells[i], [], [], None
            part = batch.column(2).slice(i, j - i).to_numpy(), batch.column(3).slice(i, j - i).to_pylist()
            if query[i]:
                names.append(part[0])
                packed += part[1]
                continue
            if not names:
                continue
            if a is None:
                a = Recordings(np.concatenate(names), packed)
                marks, brief, whole = a.index(a.marks()), a.index(a.every(True)), a.index(a.every(False))
            b = Recordings(*part)
            # a brief recording may hold no landmark of a long one: its prints meet all prints
            for index, at in ((marks, b.marks()), (brief, np.arange(len(b.prints)) if clips else b.every(True)), (whole, b.every(True))):
                for met in _meetings(index, a, b, at):
                    for columns in _passing(a, b, met, worst, least):
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "match_id", "offset", "frames", "rank", "bit_error"])
    textbuf.trim()


def _cut_at(hops: Column) -> Column:
    """Samples before those that a side gives to ``likeness``, if its print at ``hops`` is the first that meets one."""
    return F.greatest(F.lit(0), hops * HOP - HOP // 2)


def stretch(samples: Column, hops: Column, frames: Column) -> Column:
    """All that ``likeness`` reads of ``samples``, where ``frames`` prints from ``hops``
    on meet all of the shorter side, and its samples are too few for one print more."""
    return F.substring(samples, (_cut_at(hops) + 1).cast("int"), (FRAME + HOP * (LENGTH + frames)).cast("int"))


def _alike(batches: Iterable[pa.RecordBatch], alike: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = (batch.column(k).to_pylist() for k in ("sa", "sb", "offset", "moved"))
        same = [likeness(np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8), o, m) >= alike for a, b, o, m in zip(*columns, strict=True)]
        yield batch.select(["query_id", "match_id", "offset", "frames", "rank", "bit_error"]).filter(pa.array(same, pa.bool_()))


def clips(rows: DataFrame, id_col: str, samples_col: str, is_query: Column, least: int = 8) -> list[bytes] | None:
    """The samples of all queries that have prints, but fewer than ``least``, each
    once; None where they exceed ``CLIP_BYTES`` or may have landmarks."""
    if least > NEIGHBOURS:
        return None
    samples, first = F.col(samples_col).cast("binary"), FRAME + HOP * (LENGTH - 1)
    asked = rows.filter(is_query & F.col(id_col).cast("long").isNotNull()).select(samples.alias("s"))
    asked = asked.filter((F.length("s") >= first) & (F.length("s") < first + HOP * (least - 1))).distinct()
    asked = scratch.table(asked, "clips")
    if (asked.agg(F.sum(F.length("s"))).first()[0] or 0) > CLIP_BYTES:
        return None
    return sorted(bytes(r.s) for r in asked.collect())


def fingerprints(rows: DataFrame, id_col: str, samples_col: str, is_query: Column, least: int = 8, **heard: object) -> DataFrame:
    """(id, n, prints, d, asked, heard): d is a digest of the prints, of the samples below
    ``least`` prints; null or short recordings have no prints.  heard: the ``clips`` found in it."""
    samples = rows.select(F.col(id_col).cast("long").alias("id"), F.col(samples_col).cast("binary").alias("samples"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    schema = "id long, n long, prints binary, d binary, asked boolean, heard array<struct<of binary, rank long, offset long, frames long, bit_error double>>"
    return samples.mapInArrow(partial(_printed, least=least, **heard), schema)


def align(rows: DataFrame, is_query: Column, id_col: str = "doc_id", samples_col: str = "samples", worst: float = 0.12, least: int = 8, alike: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """(members, matches).

    members: (id, class_id) of every row; recordings with equal fingerprints, or
    with equal samples if they have fewer than ``least`` prints, are a class, named
    by its smallest id.  A null recording is its own.
    matches: (query_id, match_id, offset, frames, bit_error) between class names,
    for classes that hold a query, against all others.  A query is looked up by
    all its landmarks; every recording is indexed, and of the offsets that any two
    equal landmarks give, the one with most votes that passes stands.  A recording
    of fewer than ``least`` prints must be met whole, and as so few bits agree by
    chance, its samples must correlate by ``alike`` too; one without prints is in
    no match.  Rows without an id are in no match.
    """
    with scratch.scope() as made:
        asked_clips = clips(rows, id_col, samples_col, is_query, least)
        prints = scratch.table(fingerprints(rows, id_col, samples_col, is_query, least, worst=worst, alike=alike, clips=asked_clips), "prints")
        named = prints.filter("d is not null and id is not null")
        names = scratch.table(named.groupBy("d").agg(F.min("id").alias("name"), F.max("asked").alias("query")), "names")
    members = scratch.table(prints.select("id", "d").join(names, "d", "left").select("id", F.coalesce("name", "id").alias("class_id")), "members")
    # by id, so that the rows of a large class are not gathered, nor rows of equal names once more
    own = prints.filter("n > 0").join(names.withColumnRenamed("d", "of"), F.col("id") == F.col("name")).filter("d = of").select("name", "n", "prints", "query")
    own = scratch.table(own.dropDuplicates(["name"]), "recordings")
    # what short queries were heard in, by the names of both classes
    caught = prints.filter(F.size("heard") > 0).select("id", "d", F.explode("heard").alias("h"))
    caught = caught.join(names.select(F.col("d").alias("of"), F.col("name").alias("match_id")), (F.col("d") == F.col("of")) & (F.col("id") == F.col("match_id"))).select("match_id", "h")
    caught = caught.join(names.select("d", F.col("name").alias("query_id")), F.col("h.of") == F.col("d"))
    caught = scratch.table(caught.select("query_id", "match_id", "h.offset", "h.frames", "h.rank", "h.bit_error"), "caught")
    scratch.sweep(made)
    size, asked = own.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("query"), F.col("n"))), F.lit(0))).first()
    blocks, parts = -(-4 * asked // QUERY_BYTES) or 1, max(PARTS, -(-4 * size // PART_BYTES))
    block, part = F.pmod(F.xxhash64("name"), F.lit(blocks)).cast("int"), F.pmod(F.hash("name"), F.lit(parts))

    def dealt(found: DataFrame, cells: Column, query: bool) -> DataFrame:
        return found.select(F.explode(cells).alias("cell"), F.lit(query).alias("query"), "name", "prints")

    grid = dealt(own.filter("query"), F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: block * parts + p), True)
    grid = grid.unionByName(dealt(own, F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda q: q * parts + part), False))
    grid = grid.repartitionById(blocks * parts, F.col("cell")).sortWithinPartitions("cell", F.desc("query"))
    schema = "query_id long, match_id long, offset long, frames long, rank long, bit_error double"
    tried = scratch.table(grid.mapInArrow(partial(_aligned, worst=worst, least=least, clips=asked_clips is None), schema), "tried")
    sources = rows.select(F.col(id_col).cast("long").alias("id"), F.col(samples_col).cast("binary").alias("samples"))
    pairs = tried.filter(F.col("frames") < least)

    def heard(met: DataFrame, side: str, name: str, hops: Column) -> DataFrame:
        """``met`` with the stretch of one side's samples; whole samples are moved once."""
        ends = scratch.table(pairs.select(F.col(side).alias("id")).distinct(), "ends")
        whole = sources.join(ends, "id", "left_semi").filter("samples is not null").dropDuplicates(["id"])
        met = met.join(whole.withColumnRenamed("id", side), side)
        return met.withColumn(name, stretch(F.col("samples"), hops, F.col("frames"))).drop("samples")

    ahead, behind = F.greatest(F.lit(0), -F.col("offset")), F.greatest(F.lit(0), F.col("offset"))
    short = heard(heard(pairs, "query_id", "sa", ahead), "match_id", "sb", behind)
    short = short.withColumn("moved", _cut_at(ahead) - _cut_at(behind))
    short = short.mapInArrow(partial(_alike, alike=alike), schema).unionByName(caught)
    first = short.groupBy("query_id", "match_id").agg(F.min(F.struct("rank", "offset", "frames", "bit_error")).alias("b")).select("query_id", "match_id", "b.offset", "b.frames", "b.bit_error")
    return members, tried.filter(F.col("frames") >= least).drop("rank").unionByName(first)
