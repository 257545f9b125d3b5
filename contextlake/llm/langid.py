"""Language identification with hyperdimensional profiles.

Every letter has a random bipolar vector, made from its code point.  A trigram
is bound from its letters' vectors, rotated by their places; a text is the
bundle (sum) of its trigrams, and a language the bundle of its texts.  A text
gets the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contextlake.llm import textbuf

UNKNOWN = "und"
CHUNK = 1 << 20
SEEN_BITS = 22
#: Bytes of text bundled at once, and trigram vectors made at once; results are the same at any size.
BLOCK = 1 << 19
VECTORS = 1 << 12


class Profiles:
    """Bundles of texts; letter vectors are made once per process."""

    def __init__(self, dims: int, seed: int):
        self.dims, self.seed = dims, seed
        self.slot = np.zeros(0x110000, np.int32)  # 0: not a letter, -1: not seen yet
        self.slot[:] = -1
        self.letters: list[np.ndarray] = [np.zeros(dims, np.int8)]
        self.points = [0]
        self.table = np.zeros((1, dims), np.int8)
        self.bound: dict[int, np.ndarray] = {}

    def _learn(self, points: np.ndarray) -> None:
        for p in points.tolist():
            if self.slot[p] >= 0:
                continue
            c = chr(p)
            low = c.lower()
            if not c.isalpha():
                self.slot[p] = 0
            elif low != c and len(low) == 1:
                if self.slot[ord(low)] < 0:
                    self._learn(np.array([ord(low)]))
                self.slot[p] = self.slot[ord(low)]
            else:
                self.slot[p] = len(self.letters)
                self.points.append(p)
                bits = np.random.Generator(np.random.PCG64([self.seed, p])).integers(0, 2, self.dims, dtype=np.int8)
                self.letters.append((2 * bits - 1).astype(np.int8))
        self.table = np.stack(self.letters)
        self.table[0] = np.random.Generator(np.random.PCG64([self.seed])).integers(0, 2, self.dims, dtype=np.int8) * 2 - 1  # the gap between words

    def trigrams(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, counts) of the letter trigrams of one text, runs of other
        characters standing as one gap."""
        points = np.frombuffer(bytes(data).decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        s = self.slot[points]
        if (s < 0).any():
            self._learn(np.unique(points[s < 0]))
            s = self.slot[points]
        if not s.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        gap = s == 0
        keep = ~gap
        keep[1:] |= ~gap[:-1]
        s = np.concatenate([[0], s[keep], [0]]).astype(np.int64)
        codes = (s[:-2] << 42) | (s[1:-1] << 21) | s[2:]
        return np.unique(codes, return_counts=True)

    def hashes(self, codes: np.ndarray) -> np.ndarray:
        """``SEEN_BITS`` bits of each trigram's code points, equal in every process."""
        points = np.array(self.points, np.uint64)
        a, b, c = points[codes >> 42], points[(codes >> 21) & 0x1FFFFF], points[codes & 0x1FFFFF]
        return (textbuf.mix((a << np.uint64(42)) | (b << np.uint64(21)) | c) >> np.uint64(64 - SEEN_BITS)).astype(np.int64)

    def shares(self, data: np.ndarray, offsets: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """The share of each text's trigrams that are marked in ``seen``."""
        out = np.zeros(len(offsets) - 1)
        for r in range(len(out)):
            hits = total = 0
            for at in range(offsets[r], offsets[r + 1], CHUNK):
                codes, counts = self.trigrams(data[at : min(at + CHUNK, offsets[r + 1])])
                hits += int(counts[seen[self.hashes(codes)]].sum())
                total += int(counts.sum())
            out[r] = hits / max(total, 1)
        return out

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        a, b, c = self.table[codes >> 42], self.table[(codes >> 21) & 0x1FFFFF], self.table[codes & 0x1FFFFF]
        return np.roll(a, 2, axis=1) * np.roll(b, 1, axis=1) * c

    def bundles(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One row per text: the sum of its trigram vectors."""
        out = np.zeros((len(offsets) - 1, self.dims), np.float32)
        found = []
        for r in range(len(offsets) - 1):
            for at in range(offsets[r], offsets[r + 1], CHUNK):
                codes, counts = self.trigrams(data[at : min(at + CHUNK, offsets[r + 1])])
                if len(codes):
                    found.append((r, codes, counts))
        if not found:
            return out
        known, inverse = np.unique(np.concatenate([c for _, c, _ in found]), return_inverse=True)
        for lo in range(0, len(known), VECTORS):
            vectors = self.vectors(known[lo : lo + VECTORS]).astype(np.float32)
            at = 0
            for r, codes, counts in found:
                own = inverse[at : at + len(codes)]
                at += len(codes)
                if len(known) > VECTORS:
                    here = (own >= lo) & (own < lo + VECTORS)
                    out[r] += counts[here].astype(np.float32) @ vectors[own[here] - lo]
                else:
                    out[r] += counts.astype(np.float32) @ vectors[own]
        return out


@cache
def _profiles(dims: int, seed: int) -> Profiles:
    return Profiles(dims, seed)


def _sums(batches: Iterable[pa.RecordBatch], dims: int, seed: int) -> Iterator[pa.RecordBatch]:
    """(lang, dimension sums) of all texts of a task: one row per language."""
    own = _profiles(dims, seed)
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.asarray(batch.column(0).to_pylist(), dtype=object)
        for i, j, data, offsets in textbuf.blocks(batch.column(1), BLOCK):
            rows = own.bundles(data, offsets).astype(np.int64)
            for lang in set(langs[i:j]):
                total[lang] = total.get(lang, 0) + rows[langs[i:j] == lang].sum(axis=0)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))], ["lang", "bundle"])


def _met(batches: Iterable[pa.RecordBatch], dims: int, seed: int) -> Iterator[pa.RecordBatch]:
    """The trigram hashes of all texts of a task, each once."""
    own, seen = _profiles(dims, seed), np.zeros(1 << SEEN_BITS, dtype=bool)
    for batch in batches:
        for _, _, data, offsets in textbuf.blocks(batch.column(0), BLOCK):
            for r in range(len(offsets) - 1):
                for at in range(offsets[r], offsets[r + 1], CHUNK):
                    seen[own.hashes(own.trigrams(data[at : min(at + CHUNK, offsets[r + 1])])[0])] = True
    yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen).astype(np.int32))], ["h"])


def _predicted(batches: Iterable[pa.RecordBatch], dims: int, seed: int, names: list[str], prototypes: np.ndarray, known: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    own = _profiles(dims, seed)
    if known is not None:
        seen = np.zeros(1 << SEEN_BITS, dtype=bool)
        seen[known] = True
    for batch in batches:
        for i, j, data, offsets in textbuf.blocks(batch.column(batch.num_columns - 1), BLOCK):
            rows = own.bundles(data, offsets)
            norm = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))
            lang, score = [UNKNOWN] * (j - i), np.zeros(j - i)
            if names:
                cosine = rows.astype(np.float64) @ prototypes.T / np.where(norm > 0, norm, 1)[:, None]
                best = cosine.argmax(axis=1)
                score = np.where(norm > 0, np.clip(cosine[np.arange(j - i), best], 0, 1), 0)
                lang = [names[b] if n > 0 else UNKNOWN for b, n in zip(best, norm, strict=True)]
            keep = [batch.column(c).slice(i, j - i) for c in range(batch.num_columns - 1)]
            made = {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())}
            if known is not None:
                made["seen"] = pa.array(own.shares(data, offsets, seen), pa.float64())
            yield pa.RecordBatch.from_arrays([*keep, *made.values()], [*batch.schema.names[:-1], *made])


def held_out(id_col: str = "doc_id") -> Column:
    """The rows that no prototype learns from: crc32 of the id's text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def prototypes(train: DataFrame, lang_col: str = "lang", text_col: str = "text", dims: int = 512, seed: int = 11) -> tuple[list[str], np.ndarray]:
    """Names and unit prototypes of all non-null languages of ``train``.

    All rows are bundled; tasks sum their texts before anything is shuffled, so
    a language's share of the rows doesn't matter.  To the driver come ``dims``
    numbers per language.
    """
    parts = train.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string"), F.col(text_col).cast("string"))
    parts = textbuf.mapped(parts, partial(_sums, dims=dims, seed=seed), "lang string, bundle array<long>")
    sums = parts.select("lang", F.posexplode("bundle").alias("d", "x")).groupBy("lang", "d").agg(F.sum("x").alias("x"))
    rows = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("v")).select("lang", F.col("v.x").alias("v")).collect()
    rows = sorted((r for r in rows if any(r.v)), key=lambda r: r.lang)
    if not rows:
        return [], np.zeros((0, dims))
    m = np.array([r.v for r in rows], np.float64)
    return [r.lang for r in rows], m / np.sqrt((m**2).sum(axis=1, keepdims=True))


def learned(train: DataFrame, lang_col: str = "lang", text_col: str = "text", dims: int = 512, seed: int = 11) -> np.ndarray:
    """Hashes of all trigrams of the rows that ``prototypes`` learns from, 2 to
    the power of ``SEEN_BITS`` at most."""
    texts = train.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).cast("string"))
    return textbuf.mapped(texts, partial(_met, dims=dims, seed=seed), "h int").distinct().toArrow().column("h").to_numpy()


def identify(
    docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), dims: int = 512, seed: int = 11, known: np.ndarray | None = None
) -> DataFrame:
    """``keep`` columns with lang_pred and score (the cosine, 0 to 1).

    A null text or one without letters is ``und`` with score 0, as is every text
    if nothing was learned.  Ties go to the first name.  The model is a few
    vectors; columns other than ``keep`` are ignored.  With ``known`` hashes a
    column ``seen`` has the share of a text's trigrams that are among them.
    """
    names, vectors = model
    source = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    if known is not None:
        schema = schema.add("seen", "double")
    return textbuf.mapped(source, partial(_predicted, dims=dims, seed=seed, names=names, prototypes=vectors, known=known), schema)
