import tracemalloc
import zlib

import numpy as np

from contextlake.llm import langid

SAMPLES = {"en": "the house and the garden of that man with them", "de": "das haus und der garten dieser frau nicht für straße", "fr": "la maison et le jardin de cette femme être été où"}


def docs(spark, extra=()):
    rows = []
    for i in range(240):
        lang = list(SAMPLES)[i % 3]
        words = SAMPLES[lang].split()
        rng = np.random.default_rng(i)
        rows.append((i, " ".join(rng.choice(words, 12)) + ("!" * (i % 4)), lang if i % 7 else None, "x"))
    return spark.createDataFrame([*rows, *extra], "doc_id long, text string, lang string, score string").repartition(3)


def run(df):
    model = langid.prototypes(df.filter(~langid.held_out()))
    return model, langid.identify(df, model).withColumn("held_out", langid.held_out())


def test_held_out_accuracy_and_edges(spark):
    extra = [(1000, None, "en", "x"), (1001, "", "en", "x"), (1002, "12 !? 99", "de", "x"), (None, "the garden of the house", None, "x"), (1003, "the house and " * 150_000, "en", "x"), (1004, "МИР Ж", None, None)]
    model, out = run(docs(spark, extra))
    assert model[0] == ["de", "en", "fr"]
    rows = {r.doc_id: r for r in out.collect()}
    for i in range(240):
        assert rows[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    wrong = [i for i in range(240) if rows[i].lang_pred != list(SAMPLES)[i % 3]]
    assert len(wrong) <= 5
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (1000, 1001, 1002))
    assert rows[None].lang_pred == "en" and rows[1003].lang_pred == "en" and not rows[None].held_out
    assert rows[1004].lang_pred in model[0] and 0 <= rows[1004].score <= 1


def test_prototypes_equal_a_plain_bundle(spark):
    df = docs(spark)
    names, got = langid.prototypes(df)
    own = langid.Profiles(512, 11)
    total = {}
    for r in df.collect():
        if r.lang:
            data = r.text.encode()
            total[r.lang] = total.get(r.lang, 0) + own.bundles(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0].astype(float)
    for name, v in zip(names, got, strict=True):
        assert np.allclose(v, total[name] / np.linalg.norm(total[name]))


def test_bundle_is_the_sum_of_bound_trigrams():
    own = langid.Profiles(64, 3)
    data = "Ab a".encode()
    bundle = own.bundles(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]
    a, b, gap = own.table[own.slot[ord("a")]], own.table[own.slot[ord("b")]], own.table[0]
    roll = np.roll
    tri = lambda x, y, z: roll(x, 2) * roll(y, 1) * z
    assert (bundle == tri(gap, a, b) + tri(a, b, gap) + tri(b, gap, a) + tri(gap, a, gap)).all()
    assert own.slot[ord("A")] == own.slot[ord("a")]


def test_nothing_learned(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert run(empty)[1].count() == 0
    one = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[:3] for r in run(one)[1].collect()] == [(1, "und", 0.0)]


def test_a_worker_bundles_in_bounded_memory():
    rng = np.random.default_rng(4)
    text = "".join(map(chr, rng.integers(97, 123, 60_000))).encode()  # most of the 17,576 trigrams
    own = langid.Profiles(512, 11)
    tracemalloc.start()
    own.bundles(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
