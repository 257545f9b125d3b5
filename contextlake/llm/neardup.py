"""Near-duplicate documents by bottom-k sketches from one hash function.

1. Every text becomes its set of word shingles (64-bit hashes) and keeps the
   ``k`` smallest of them.  Documents with equal sets form one class; only the
   class's first row goes on.
   The parities of the retained values in ``BITS`` bits are its signature.
2. Inverted lists of retained values.  Two sets with Jaccard 0.8 share, among
   the retained values, at least ``c``: by counting for small sets, by the
   lower tail of a binomial for others.  So it is enough to list a document
   under its ``k - c + 1`` rarest retained values: two such documents then meet
   in a list, and a document that shares less is in none, however common a
   passage of it is.
3. A short list gives all its pairs.  A longer one has two centres: the member
   with the smallest number, and the member whose listed values are the most common.
   Members are paired with the centres only: as many pairs as list entries, and
   never all pairs of a group.
4. Pairs go whose signatures differ in more bits than ``c`` shared values leave
   room for.  The union sketch (``k`` smallest of two sketches) estimates the similarity
   and drops pairs far below the threshold; exact Jaccard on whole sets decides.
5. Linked pairs give components.  The members of long lists that still hold
   several components are joined once more, exactly and on their whole sets: in
   one order of all values, rarest first, two linked sets share a value among the
   first of each, and its places bound what they can share beyond it.  Entries
   meet by value and size class, and only those of different components whose
   places and sizes allow a link.  No cap is set on any list.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import partial
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contextlake.llm import graph, scratch, textbuf

BROADCAST_IDS = 500_000
#: Lists up to this length give all their pairs; longer ones go by centres.
SHORT = 16
#: Bits of a signature; a value that only one of two sketches holds flips one.
BITS = 256
#: Bitmaps of keys: bits for a key, the most bits of all (8 MB), bits of a part (Spark's own).
SPARSE, MAP_BITS, MAP_PART = 16, 1 << 26, 1 << 15
#: Bytes of text hashed at once; working memory is some 60 times that, and results are the same at any size.
BLOCK = 1 << 19


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct int64 shingle hashes of each text of a block."""
    data = textbuf.lower(data)
    starts, ends, row = textbuf.words(data, offsets, textbuf.SPACE)
    h = textbuf.word_hashes(data, starts, ends)
    first = np.searchsorted(row, np.arange(len(offsets)))
    n = len(h) - width + 1
    joined = np.zeros(max(n, 0), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width if n > 0 else 0):
            joined = textbuf.mix(joined * np.uint64(0xD6E8FEB86659FD93) + h[i : i + n])
        joined = joined.view(np.int64)
        for r in range(len(offsets) - 1):
            a, b = first[r], first[r + 1]
            if b - a >= width:
                s = np.sort(joined[a : b - width + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif b > a:  # the whole sequence is one shingle, unlike any full one
                acc = np.full(1, b - a, np.uint64)
                for x in h[a:b]:
                    acc = textbuf.mix(acc * np.uint64(0xA24BAED4963EE407) + x)
                yield acc.view(np.int64)
            else:
                yield np.zeros(0, np.int64)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)])))


def _sketches(batches: Iterable[pa.RecordBatch], width: int, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in textbuf.blocks(batch.column(1), BLOCK):
            size, d1, d2, low, odd = [], [], [], [], []
            for s in shingle_sets(data, offsets, width):
                size.append(len(s))
                digest = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                d1.append(digest[0])
                d2.append(digest[1])
                low.append(s[:k].copy())
                parity = np.bincount(low[-1] & (BITS - 1), minlength=BITS) & 1  # the lower bits are uniform
                odd.append(np.packbits(parity.astype(np.uint8)).view(np.int64))
            columns = [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(size, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), _lists(low), _lists(odd)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "own", "n", "d1", "d2", "low", "odd"])


def _whole_sets(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in textbuf.blocks(batch.column(1), BLOCK):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), _lists(list(shingle_sets(data, offsets, width)))], ["id", "whole"])


def least_shared(k: int, share: float, risk: float) -> int:
    """Largest c with P(Binomial(k, share) < c) <= risk."""
    below, c = 0.0, 0
    while below + (p := comb(k, c) * share**c * (1 - share) ** (k - c)) <= risk:
        below += p
        c += 1
    return max(c, 1)


def shared_values(n: Column, t: float, k: int, risk: float) -> Column:
    """Number of retained values that a set of ``n`` shares with any set of
    Jaccard ``t`` or more.

    With partners of size m from t*n to n/t, the sets share t/(1+t) * (n+m)
    values, less those beyond the k-th of either; the worst m is an end of that
    range.  Above k, the binomial bound holds as well.
    """

    def beyond(m: Column) -> Column:
        return F.greatest(m - k, F.lit(0.0))

    sure = F.least(n * t - beyond(n) - beyond(n * t), n - beyond(n) - beyond(n / t))
    sure = F.ceil(sure - 1e-9)
    return F.greatest(F.when(n > k, F.greatest(sure, F.lit(least_shared(k, t, risk)))).otherwise(sure), F.lit(1))


def _roomy(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures allow as many shared values as a link needs.

    Of ``held`` values on either side, those of one side alone flip a bit at most.
    """
    x = lists.select(F.col("id").alias("a"), F.struct("held", "need", "odd").alias("x"))
    y = lists.select(F.col("id").alias("b"), F.struct("held", "need", "odd").alias("y"))
    flipped = " + ".join(f"bit_count(x.odd[{i}] ^ y.odd[{i}])" for i in range(BITS // 64))
    found = pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b")
    return found.filter(f"{flipped} <= x.held + y.held - 2 * greatest(x.need, y.need)").select("a", "b")


def _plausible(pairs: DataFrame, lists: DataFrame, pct: int, k: int, margin: float) -> DataFrame:
    """Pairs (a, b) that the union sketch does not rule out."""
    la = lists.select(F.col("id").alias("a"), F.col("low").alias("la"))
    lb = lists.select(F.col("id").alias("b"), F.col("low").alias("lb"))
    union = F.slice(F.array_sort(F.array_union("la", "lb")), 1, k)
    hits = F.size(F.array_intersect(union, F.array_intersect("la", "lb")))
    return pairs.join(la.hint("merge"), "a").join(lb.hint("merge"), "b").filter(hits >= F.size(union) * (pct / 100 - margin)).select("a", "b")


def _exact(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with their set sizes and the size of the intersection."""
    wa = sets.select(F.col("id").alias("a"), F.col("whole").alias("wa"))
    wb = sets.select(F.col("id").alias("b"), F.col("whole").alias("wb"))
    found = pairs.join(wa.hint("merge"), "a").join(wb.hint("merge"), "b")
    return found.select("a", "b", F.size("wa").cast("long").alias("na"), F.size("wb").cast("long").alias("nb"), F.size(F.array_intersect("wa", "wb")).cast("long").alias("both"))


def _size_class(n: str) -> str:
    """SQL for the size class of ``n``: classes grow by a twentieth."""
    return f"cast(floor(ln({n}) / ln(1.05)) as int)"


def _across(members: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """Pairs (a, b) of ``members`` (id, comp) in different components that can be linked.

    A value has the same rank in every set, rarest first.  Where it is the first
    value that two sets share, they share at most the smaller number of values
    from it on, ``r``, and a link of sizes m <= n needs pct / (100 + pct) * (m + n)
    of them.  So the smaller set is listed under values with a link to its own
    size in reach, the larger one under all size classes within reach.
    """
    values = scratch.table(members.join(sets, "id").select("id", "comp", F.size("whole").alias("n"), F.explode("whole").alias("v")), "values")
    common = values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    ranked = values.join(common, "v").groupBy("id", "comp", "n").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("s"))
    # values of one set alone come first and meet nothing
    first = ranked.select("id", "comp", "n", F.expr(f"slice(s, 1, greatest(0, cast(size(s) - ceil(n * {pct} / 100 - 1e-9) + 1 as int)))").alias("p"), F.size("s").alias("m"))
    entries = first.select("id", "comp", "n", "m", F.posexplode("p").alias("j", "p")).select("id", "comp", "n", F.col("p.v").alias("v"), (F.col("m") - F.col("j")).alias("r"))
    entries = scratch.table(entries, "entries")
    small = entries.filter(f"{100 + pct} * r >= {2 * pct} * n").withColumn("w", F.expr(_size_class("n")))
    reach = f"least(n, floor({100 + pct} * r / {pct} + 1e-9) - n)"
    low = f"ceil(n * {pct} / 100 - 1e-9)"
    large = entries.filter(f"{reach} >= {low}").withColumn("w", F.explode(F.expr(f"sequence({_size_class(low)}, {_size_class(reach)})")))
    both = small.select("v", "w", "comp").unionByName(large.select("v", "w", "comp"))
    by_comp = both.groupBy("v", "w", "comp").agg(F.count(F.lit(1)).alias("len"))
    split = by_comp.groupBy("v", "w").agg(F.max(F.struct("len", "comp")).alias("m"), F.count(F.lit(1)).alias("comps")).filter("comps > 1")
    split = scratch.table(split.select("v", "w", F.col("m.comp").alias("main")), "split").hint("merge")
    small = scratch.table(small.join(split, ["v", "w"]), "small")
    large = scratch.table(large.join(split, ["v", "w"]), "large")
    fits = f"""x.v = y.v and x.w = y.w and x.comp <> y.comp and (x.n < y.n or x.n = y.n and x.id < y.id)
        and {100 + pct} * least(x.r, y.r) >= {pct} * (x.n + y.n)"""
    # of equal sizes, either may be the smaller: the one with the smaller id is
    found = [
        one.alias("x").join(two.alias("y"), F.expr(fits)).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
        for one, two in ((small.filter("comp <> main"), large), (small.filter("comp = main"), large.filter("comp <> main")))
    ]
    return found[0].unionByName(found[1]).distinct()


def _linked(pct: int) -> Column:
    return F.col("both") * 100 >= pct * (F.col("na") + F.col("nb") - F.col("both"))


def _key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def _once(df: DataFrame, key: str) -> DataFrame:
    """One row per ``key`` of rows with ``times``, the number of rows that share it."""
    several = df.filter("times > 1")
    return df.filter("times = 1").unionByName(several.dropDuplicates([key]))


def _marked(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` with ``_hit``: false only where ``_key`` is not in ``keys``.

    Keys set one bit each of a bitmap, ``SPARSE`` bits for a key and ``MAP_BITS``
    at most, which is broadcast; rows without a hit are never shuffled, and the
    others are to be joined with the keys, as some hits are by chance.
    """
    wanted = max(1, -(-min(keys.count() * SPARSE, MAP_BITS) // MAP_PART))
    parts = 1 << (wanted - 1).bit_length()
    part, bit = F.col("_key").bitwiseAND(F.lit(parts - 1)), F.shiftright("_key", 32).bitwiseAND(F.lit(MAP_PART - 1))
    bits = keys.select(part.alias("_part"), bit.alias("_bit")).repartition("_part").groupBy("_part").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    bits = F.broadcast(scratch.table(bits, "bits"))
    found = rows.withColumn("_part", part).join(bits, "_part", "left")
    found = found.withColumn("_bit", bit)
    hit = F.expr("cast(conv(hex(substring(_bits, cast(_bit div 8 as int) + 1, 1)), 16, 10) as int) & (1 << cast(_bit % 8 as int)) <> 0")
    return found.withColumn("_hit", F.coalesce(hit, F.lit(False))).drop("_part", "_bit", "_bits")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, pct: int = 80, k: int = 64, risk: float = 1e-7, margin: float = 0.25) -> DataFrame:
    """(id, key, n, comp) of every row: ``key`` a hash of id and text, ``n`` the size
    of its set, ``comp`` the same number for all rows of a component.

    Parameters and links are those of ``near_duplicates``.  Inside, rows go by
    numbers of their own, which are written with the sketches and compress well.
    """
    texts = docs.select(_key(id_col, text_col).alias("key"), F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("own"))
    sketched = textbuf.mapped(texts, partial(_sketches, width=shingle_words, k=k), "key long, own long, n long, d1 long, d2 long, low array<long>, odd array<long>")
    with scratch.scope() as made:
        sketches = scratch.table(sketched.withColumn("id", F.monotonically_increasing_id()), "sketches")
        full, bare = sketches.filter("n > 0"), sketches.filter("n = 0").drop("d1", "d2")
        equal = full.groupBy("d1", "d2").agg(F.min(F.struct("id", "key")).alias("rep"), F.count(F.lit(1)).alias("c"))
        copies = equal.filter("c > 1").select("d1", "d2", F.col("rep.id").alias("rep"), F.col("rep.key").alias("rep_key"))
        copies = scratch.table(copies, "copies").hint("merge")  # sketches move this once, whatever the number of copies
        rows = full.join(copies, ["d1", "d2"], "left").drop("d1", "d2").unionByName(bare, allowMissingColumns=True)
        others = F.col("rep") != F.col("id")
        rows = rows.withColumn("low", F.when(others, None).otherwise(F.col("low"))).withColumn("odd", F.when(others, None).otherwise(F.col("odd")))
        rows = scratch.table(rows, "rows")
    scratch.sweep(made[:-1])
    several = scratch.table(rows.filter("n > 0 and key = rep_key").groupBy(F.col("rep").alias("id")).agg(F.count(F.lit(1)).alias("times")).filter("times > 1"), "several")
    reps = rows.filter("n > 0 and (rep is null or rep = id)").select("id", "n", "low", "odd")

    values = reps.select("id", F.explode("low").alias("v"))
    shared = scratch.table(values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "shared")
    need = shared_values(F.col("n"), pct / 100, k, risk)
    listed = (
        values.join(shared.hint("merge"), "v")  # one plan at every size: shared values outgrow any broadcast
        .groupBy("id")
        .agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("s"))
        .join(reps.select("id", "n", "odd", F.least("n", F.lit(k)).alias("held")), "id")
        .withColumn("take", (F.size("s") - need + 1).cast("int"))  # values of one document stand first and meet nothing
        .filter("take > 0")
        .withColumn("s", F.expr("slice(s, 1, take)"))
        .select("id", "n", need.cast("int").alias("need"), "held", "odd", F.expr("aggregate(s, 0L, (a, x) -> a + x.df)").alias("pop"), F.expr("transform(s, x -> x.v)").alias("pre"))
    )
    lists = scratch.table(listed, "lists")

    entries = lists.select("id", "n", "pop", F.explode("pre").alias("v"))
    best, first = F.max(F.struct("pop", (-F.col("id")).alias("neg"), "id", "n")), F.min(F.struct("id", "n"))
    found = entries.groupBy("v").agg(best.alias("m"), first.alias("f"), F.count(F.lit(1)).alias("len")).filter("len > 1")
    centres = scratch.table(found.select("v", F.array(F.struct("m.id", "m.n"), "f").alias("c"), "len"), "centres")
    near = f"x.n * 100 >= {pct} * y.n and y.n * 100 >= {pct} * x.n"

    short = entries.select("id", "n", "v").join(centres.filter(F.col("len") <= SHORT).select("v"), "v")
    short = short.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("l"))
    nearby = f"flatten(transform(l, (x, i) -> transform(filter(slice(l, i + 2, {SHORT}), y -> {near}), y -> struct(x.id as a, y.id as b))))"
    few_pairs = short.select(F.explode(F.expr(nearby)).alias("p")).select("p.a", "p.b").distinct()

    stars = entries.select("id", "n", "v").join(centres.filter(F.col("len") > SHORT), "v").select("id", "n", F.explode("c").alias("y"))
    stars = scratch.table(stars.select("id", "n", F.col("y.id").alias("centre"), F.col("y.n").alias("m")).filter("id <> centre").distinct(), "stars")
    star_pairs = stars.filter(f"n * 100 >= {pct} * m and m * 100 >= {pct} * n").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b"))
    near_pairs = scratch.table(_roomy(few_pairs.unionByName(star_pairs).distinct(), lists), "pairs")

    def ends(pairs: DataFrame) -> DataFrame:
        """The distinct ids of pairs, for a broadcast while they are few."""
        ids = scratch.table(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
        return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids

    # estimates need only the upper halves of values, which keep their order
    upper = F.transform("low", lambda v: F.shiftright(v, 32).cast("int")).alias("low")
    lows = scratch.table(reps.select("id", upper).join(ends(near_pairs), "id"), "lows")
    likely = scratch.table(_plausible(near_pairs, lows, pct, k, margin), "likely")

    def whole(ids: DataFrame) -> DataFrame:
        wanted = rows.select("id", "key").join(ids, "id").join(several, "id", "left")
        wanted = scratch.table(wanted.select("id", "key", F.coalesce("times", F.lit(1)).alias("times")), "wanted")
        few = wanted.count() <= BROADCAST_IDS
        needed = texts.select("key", "text").join(F.broadcast(wanted) if few else wanted, "key")
        if not wanted.filter("times > 1").isEmpty():
            needed = _once(needed, "id")
        return scratch.table(textbuf.mapped(needed.select("id", "text"), partial(_whole_sets, width=shingle_words), "id long, whole array<long>"), "sets")

    sets = whole(ends(likely))
    links = scratch.table(_exact(likely, sets), "verified").filter(_linked(pct)).select("a", "b")
    comp = graph.components(links)

    members = stars.select("id", "centre").join(comp.withColumnRenamed("node", "id"), "id", "left").select("centre", F.coalesce("comp", "id").alias("comp"), "id")
    members = scratch.table(members, "members")
    open_stars = members.groupBy("centre").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("centre")
    members = scratch.table(members.join(scratch.table(open_stars, "open"), "centre").select("id", "comp").distinct(), "members")
    missing = scratch.table(members.select("id").join(sets.select("id"), "id", "left_anti"), "missing")
    if not missing.isEmpty():
        sets = sets.unionByName(whole(missing))
    again = scratch.table(_across(members, sets, pct).join(likely, ["a", "b"], "left_anti"), "again")
    more = scratch.table(_exact(again, sets.join(ends(again), "id")), "verified").filter(_linked(pct)).select("a", "b")
    if not more.isEmpty():
        comp = graph.extended(comp, more)

    node = rows.select("own", "key", "n", F.coalesce("rep", "id").alias("node"))
    return node.join(comp, "node", "left").select(F.col("own").alias("id"), "key", "n", F.coalesce("comp", "node").alias("comp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, pct: int = 80, k: int = 64, risk: float = 1e-7, margin: float = 0.25) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``.

    Links join documents whose shingle sets have a Jaccard similarity of at
    least ``pct`` percent; ``component_id`` is the smallest id reachable (null if
    no row reached has an id) and ``kept`` marks the rows whose id it is.  A null
    or wordless text has an empty set and is linked with nothing.  Rows that repeat
    id and text are one document; rows that repeat an id with other texts are
    documents of their own, and their id alone links nothing.  Documents without
    an id take part like others.  Other columns are ignored; an empty table gives
    an empty one.

    ``margin``: a pair is dropped unverified only if its sketch estimate is that
    far below the threshold (five standard errors at k = 64).  ``risk``: the
    probability that the lists miss a pair exactly at the threshold.  With
    ``risk=0, margin=1`` every pair that shares any retained value is verified.
    """
    rows = scratch.settled(lambda: grouped(docs, id_col, text_col, shingle_words, pct, k, risk, margin), "groups")
    several = rows.groupBy("comp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    out = rows.join(scratch.table(several, "least"), "comp", "left").withColumn("component", F.coalesce("least", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """One row of ``docs`` for each group of near duplicates, with all its columns:
    that with the smallest id, rows without one last, and of the texts of a repeated
    id the one with the smallest hash.

    Rows that repeat id and text are one document and one of them stays.  Null and
    wordless texts are in no group and all stay.
    """

    def chosen() -> DataFrame:
        rows = scratch.table(grouped(docs, id_col, text_col, **options), "groups")
        each = scratch.table(rows.filter("n > 0").groupBy("comp", "id", "key").agg(F.count(F.lit(1)).alias("times")), "each")
        first = F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("m")
        groups = each.groupBy("comp").agg(first, F.count(F.lit(1)).alias("c"), F.max("times").alias("most")).filter("c > 1 or most > 1")
        groups = scratch.table(groups.select("comp", F.col("m.key").alias("first")), "several")
        # keys without an entry are rows that stay as they are
        listed = each.join(groups, "comp").select(F.col("key").alias("_key"), (F.col("key") == F.col("first")).alias("_stays"), "times")
        return listed.filter("not _stays or times > 1").drop("times")

    listed = scratch.settled(chosen, "listed")
    keyed = _marked(docs.withColumn("_key", _key(id_col, text_col)), listed.select("_key"))
    hits = keyed.filter("_hit").join(listed.hint("merge"), "_key", "left")
    kept = keyed.filter("not _hit").select(docs.columns).unionByName(hits.filter("_stays is null").select(docs.columns))
    again = listed.filter("_stays")
    if not again.isEmpty():
        kept = kept.unionByName(hits.filter("_stays").dropDuplicates(["_key"]).select(docs.columns))
    return kept
