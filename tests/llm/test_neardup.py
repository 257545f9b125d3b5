import random
import re
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from contextlake.llm import graph, neardup
from contextlake.llm.neardup import least_shared, near_duplicates, shared_values, survivors

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def brute(rows, width=2, pct=80):
    sets = {}
    for i, t in rows:
        w = WORD.findall(fold(t or ""))
        sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= pct * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {(i, len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["É", "é", "Straße"]
    rows, i = [], 0
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 5, 30, 120, 300]))]
        for _ in range(rng.choice([1, 1, 2, 6, 12])):
            w = [x if rng.random() > 0.04 else rng.choice(vocab) for x in base]
            rows.append((i, rng.choice([" ", "\n", " \t"]).join(w) if rng.random() > 0.2 else " ".join(base).upper()))
            i += 1
    return [*rows, (i, None), (i + 1, ""), (i + 2, " \n\t"), (i + 3, "one"), (i + 4, "One"), (i + 5, "one\x00two"), (i + 6, "a b c")]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = corpus(seed)
    random.Random(seed).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {tuple(r) for r in near_duplicates(docs, shingle_words=2).collect()}
    assert got == brute(rows)


def test_five_word_shingles(spark):
    rows = corpus(3)
    got = {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, width=5)


def test_edges(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = " ".join(f"t{i}" for i in range(300_000))
    rows = [(1, long, "x", 1), (2, long, "y", 2), (2, long, "y", 2), (None, "a b c", None, 3), (None, long, None, 4), (3, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string, n int")
    got = sorted((tuple(r) for r in near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 299_996, 1, True), (2, 299_996, 1, False), (2, 299_996, 1, False), (None, 1, None, True), (None, 299_996, 1, False), (3, 0, 3, True)], key=str)
    stay = sorted((tuple(r) for r in survivors(docs).collect()), key=str)
    assert stay == sorted([rows[0], rows[3], rows[5]], key=str)
    assert survivors(docs.limit(0)).columns == docs.columns


def test_repeated_and_missing_ids(spark):
    """An id with two texts is two documents; documents without an id link like others."""
    rng = random.Random(3)
    x, y, z = (" ".join(f"{c}{rng.random()}" for _ in range(60)) for c in "xyz")
    rows = [(7, x), (7, y), (9, x + " more"), (8, y + " more"), (None, z), (None, z), (None, z + " more"), (None, None), (5, ""), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    n = {x: 56, y: 56, x + " more": 57, y + " more": 57, z: 56, z + " more": 57, None: 0, "": 0}
    want = [(i, n[t], 7 if t and t[0] in "xy" else i, i not in (8, 9)) for i, t in rows]
    assert sorted((tuple(r) for r in near_duplicates(docs).collect()), key=str) == sorted(want, key=str)
    stay = [tuple(r) for r in survivors(docs).collect()]
    assert len(stay) == 6 and {(7, x), (7, y), (None, None), (5, "")} <= set(stay)
    assert len([1 for i, t in stay if t and t.startswith("z")]) == 1


def shuffled_bytes(plan):
    """Bytes of all rows that the exchanges of a plan that has run were given."""
    name, own = plan.nodeName(), 0
    if name == "AdaptiveSparkPlan":
        return shuffled_bytes(plan.executedPlan())
    if name.endswith("QueryStage"):
        return shuffled_bytes(plan.plan())
    if name == "Exchange":
        own = plan.metrics().get("dataSize").get().value()
    return own + sum(shuffled_bytes(plan.children().apply(i)) for i in range(plan.children().size()))


def test_texts_that_stay_are_not_shuffled(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(200))) for i in range(600)]
    rows += [(1000 + i, t + " more") for i, t in rows[:30]] + [rows[40]] * 3 + [(None, rows[50][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    try:
        for n in names:
            spark.conf.set(n, -1)
        out = survivors(docs)
        assert sorted(map(tuple, out.collect())) == rows[:600]
        assert 0 < shuffled_bytes(out._jdf.queryExecution().executedPlan()) < 0.4 * sum(len(t) for _, t in rows)
    finally:
        for n in names:
            spark.conf.unset(n)


def test_marked_rows_hold_all_keys_at_any_size_of_the_bitmap(spark, monkeypatch):
    keys = spark.range(0, 40_000, 2).select(F.xxhash64("id").alias("_key"))
    rows = spark.range(40_000).select("id", F.xxhash64("id").alias("_key"))
    for most, share in ((neardup.MAP_BITS, 0.1), (1 << 15, 0.6)):
        monkeypatch.setattr(neardup, "MAP_BITS", most)
        hits = neardup._marked(rows, keys).groupBy((F.col("id") % 2).alias("odd")).agg(F.sum(F.col("_hit").cast("int")).alias("n"))
        n = {r.odd: r.n for r in hits.collect()}
        assert n[0] == 20_000 and 0 < n[1] < share * 20_000
    assert neardup._marked(rows, keys.limit(0)).filter("_hit").isEmpty()


def test_near_copies_of_one_document(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    rows = [(i, " ".join(w if rng.random() > 0.03 * (i % 5) else f"z{rng.random()}" for w in base)) for i in range(120)]
    got = {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=2).collect()}
    assert got == brute(rows)


def one_base(n, words=60):
    """Copies of one text, each with a few words of its own: many pairs near the threshold."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(words)]
    return [(i, " ".join(w if rng.random() > 0.02 * (i % 7) else f"z{rng.random()}" for w in base)) for i in range(n)]


def test_pairs_of_one_group_grow_in_proportion(spark, monkeypatch):
    made = []
    exact = neardup._exact
    monkeypatch.setattr(neardup, "_exact", lambda pairs, sets: made.append(pairs.count()) or exact(pairs, sets))
    tried = {}
    for n in (150, 600):
        made.clear()
        rows = one_base(n)
        got = {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=2).collect()}
        assert got == brute(rows)
        tried[n] = sum(made)
    assert tried[600] <= 6 * tried[150] and tried[600] < 600 * 20


def test_exact_mode(spark):
    rows = corpus(4)
    got = {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=2, risk=0, margin=1).collect()}
    assert got == brute(rows)


def test_least_shared_is_a_lower_tail():
    assert 28 <= least_shared(64, 0.8, 1e-7) <= 36


def test_shared_values_is_a_lower_bound(spark):
    """Over all overlaps of two random sets with Jaccard 0.8 or more."""
    rng = random.Random(9)
    k, pairs = 16, []
    for _ in range(3000):
        n = rng.randrange(1, 40)
        a = set(rng.sample(range(10**6), n))
        b = set(rng.sample(sorted(a), max(1, n - rng.randrange(n // 5 + 1)))) | set(rng.sample(range(10**6), rng.randrange(n // 4 + 1)))
        if len(a & b) >= 0.8 * len(a | b):
            pairs.append((n, len(set(sorted(a)[:k]) & set(sorted(b)[:k]))))
    need = {r.n: r.need for r in spark.range(1, 60).withColumnRenamed("id", "n").select("n", shared_values(F.col("n"), 0.8, k, 1e-7).alias("need")).collect()}
    assert len(pairs) > 500 and all(got >= need[n] for n, got in pairs)


def test_extended_components_equal_components_of_all_edges(spark):
    rng = random.Random(4)
    first = [(rng.randrange(60), rng.randrange(60)) for _ in range(25)]
    second = [(rng.randrange(80), rng.randrange(80)) for _ in range(12)]

    def table(edges):
        return spark.createDataFrame(edges, "a long, b long")

    whole = {r.node: r.comp for r in graph.components(table(first + second)).collect()}
    parts = {r.node: r.comp for r in graph.extended(graph.components(table(first)), table(second)).collect()}
    assert parts == whole


def test_a_worker_gives_its_memory_back():
    code = r'''
import random, re, pyarrow as pa
from contextlake.llm import neardup
texts = [" ".join(f"w{random.randrange(5000)}" for _ in range(400)) for _ in range(4000)]
batch = pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array(texts), pa.array(range(4000))], ["key", "text", "own"])
held = lambda: int(re.search(r"\nPss_Anon:\s+(\d+)", open("/proc/self/smaps_rollup").read())[1]) >> 10
before = held()
assert sum(b.num_rows for b in neardup._sketches([batch], 5, 64)) == 4000
print(held() - before)
'''
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).resolve().parents[2])
    assert int(run.stdout) < 30
