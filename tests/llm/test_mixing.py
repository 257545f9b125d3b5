import math
import random
import re

import pytest
from pyspark.sql import functions as F

from contextlake.llm.mixing import pareto_mix, targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, size string"


def reshared(sizes, weights=(5, 2, 1), share=1.5, limit=2.0):
    """Targets by repeated resharing of what is above a limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, total = {}, share * sum(sizes.values())
    while True:
        left = total - sum(fixed.values())
        mass = sum(w[s] for s in names if s not in fixed)
        t = {s: fixed.get(s, left * w[s] / mass if mass else 0) for s in names}
        over = [s for s in names if s not in fixed and t[s] > limit * sizes[s] + 1e-9]
        if not over:
            return t
        fixed |= {s: limit * sizes[s] for s in over}


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_repeated_resharing(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 3, 10, 1000, 50_000]) for s in [None, "", "b", "ä", "Z", "a", "😀", "src10", "src9"][: rng.randint(1, 9)]}
    got = {r[0]: r[2] for r in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), "source", (5, 2, 1), 1.5, 2.0).collect()}
    want = reshared(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * (1 + want[s]) for s in want)


def rows(seed, n=3000):
    rng = random.Random(seed)
    source = lambda: "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "c", None, "😀", "tiny"])
    out = [(i, " ".join(["w"] * int(rng.paretovariate(1.2) * 3)), source(), "x") for i in range(n)]
    return out + [(n, None, "a", "x"), (n + 1, "", "a", "x"), (n + 2, " \t\n", None, None), (None, "no id", "b", "x"), (n + 3, "é\xa0é x", "only", "x")]


def test_mix_meets_targets_and_reruns_agree(spark):
    data = rows(1)
    out = pareto_mix(spark.createDataFrame(data, SCHEMA).repartition(7), keep=("source",)).collect()
    again = pareto_mix(spark.createDataFrame(data[::-1], SCHEMA).repartition(3), keep=("source",)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    count = {i: len(WORD.findall(t or "")) for i, t, _, _ in data}
    sizes = {}
    for i, _, s, _ in data:
        sizes[s] = sizes.get(s, 0) + count[i]
    want = reshared(sizes)
    taken, largest = {}, {}
    for r in out:
        assert r.size == count[r.doc_id] and r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * (1 + r.target)
        assert 0 <= r.copies <= 2 and r.taken == r.copies * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r.size)
    assert len(out) == len(data)
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6 for s in sizes)


def test_sampling_is_by_inclusion_odds(spark):
    """With equal sizes, a priority of 4 is taken more often than one of 1."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("w w").alias("text"), F.lit("s").alias("source"), (F.col("id") % 2).alias("p"))
    out = pareto_mix(docs, weights=(1,), share=0.2, priority=F.when(F.col("p") == 1, 4.0).otherwise(1.0), keep=("p",))
    got = {r.p: r.n for r in out.groupBy("p").agg(F.sum("copies").alias("n")).collect()}
    assert abs(got[0] + got[1] - 800) <= 1 and 2.5 < got[1] / got[0] < 6


def level_of(docs, target, limit=2.0):
    """The level c with sum(size * min(limit, c * priority)) = target, by bisection."""
    lo, hi = 0.0, 1e9
    for _ in range(200):
        c = (lo + hi) / 2
        lo, hi = (c, hi) if sum(n * min(limit, c * p) for n, p in docs) < target else (lo, c)
    return lo


def test_default_odds_differ_within_a_source(spark):
    """Expected copies follow log2(1 + words) at one level, cut at the limit; over
    many seeds every kind of document is taken that often."""
    kinds = {1: 600, 7: 400, 63: 120, 1023: 20}
    data, i = [], 0
    for words, many in kinds.items():
        for _ in range(many):
            data.append((i, "w " * words, "s", "x"))
            i += 1
    docs = spark.createDataFrame(data, SCHEMA).cache()
    for share in (0.3, 1.2, 1.9):
        total = sum(w * n for w, n in kinds.items())
        level = level_of([(w, math.log2(1 + w)) for w, n in kinds.items() for _ in range(n)], share * total)
        sums, seeds = dict.fromkeys(kinds, 0), 4
        for seed in range(seeds):
            out = pareto_mix(docs, weights=(1,), share=share, seed=seed)
            for r in out.groupBy("size").agg(F.sum("copies").alias("c"), F.max("copies").alias("m")).collect():
                sums[r["size"]] += r.c
                assert r.m <= 2
        for w, n in kinds.items():
            want = min(2.0, level * math.log2(1 + w))
            assert abs(sums[w] / (n * seeds) - want) < 0.02 + 3 * (want % 1 * (1 - want % 1) / (n * seeds)) ** 0.5, (share, w)


@pytest.mark.parametrize("first", [1, None])
def test_equal_rows_meet_the_target(spark, first):
    """4,000 equal rows are taken one by one, whatever their id."""
    data = [(first, "a b c d e f g", "s", "x")] * 4000 + [(2, "h i", "t", "x"), (3, "j " * 9000, "u", "x")]
    out = pareto_mix(spark.createDataFrame(data, SCHEMA).repartition(6), weights=(1,), share=0.6)
    taken, target = out.filter("size = 7").agg(F.sum("taken"), F.max("target")).first()
    assert out.count() == 4002 and target < 28_000 and abs(taken - target) <= 3.5
    again = pareto_mix(spark.createDataFrame(data, SCHEMA).repartition(2), weights=(1,), share=0.6)
    assert sorted(map(str, out.collect())) == sorted(map(str, again.collect()))


def test_empty_and_repeated(spark):
    assert pareto_mix(spark.createDataFrame([], SCHEMA)).count() == 0
    twice = spark.createDataFrame([(1, "a b", "s", "x")] * 6 + [(2, None, None, None)], SCHEMA)
    out = pareto_mix(twice).collect()
    assert len(out) == 7 and {r.size for r in out} == {2, 0} and all(r.taken <= 2 * r.size for r in out)
