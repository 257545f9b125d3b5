import numpy as np

from contextlake.llm import toxicity

DOCS = "doc_id long, text string, grade string"
BAD = ["idiot", "scum", "moron", "clown", "trash", "loser"]


def corpus(spark, n=900):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        text = list(rng.choice(words, 40))
        grade = i % 3
        if grade:
            text[3 : 3 + 2 * grade] = rng.choice(BAD, 2 * grade)
        docs.append((i, " ".join(text).title(), "x"))
        if i % 2:
            labels.append((i, 1, int(grade > 0)))
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame([*labels, (None, 1, 1), (4, None, 1), (6, 1, None)], "doc_id long, quality int, toxic int")


def test_held_out_grades(spark):
    docs, labels = corpus(spark)
    model = toxicity.learn(docs, labels)
    assert model.cuts[0] < model.cuts[1]
    rows = [r for r in toxicity.grade(docs, model).collect() if r.doc_id % 2 == 0]
    assert np.mean([r.toxic == (r.doc_id % 3 > 0) for r in rows]) > 0.97
    means = [np.mean([r.severity for r in rows if r.doc_id % 3 == g]) for g in range(3)]
    assert means[0] < means[1] < means[2] and all(0 <= r.severity <= 2 for r in rows)


def test_gradient_equals_differences():
    """One Adagrad step goes down the numerical gradient of the likelihood."""
    f = np.array([1, 5])

    def loss(grade, z, cuts):
        above = [1.0, *toxicity._logistic(z - np.array(cuts)), 0.0]
        return -np.log(above[grade] - above[grade + 1])

    for grade in range(3):
        model = toxicity.fit([(grade, f)], epochs=1, sparse=0.0)
        slope = loss(grade, 1e-6, [2.0, 4.0]) - loss(grade, -1e-6, [2.0, 4.0])
        assert np.sign(model.weights[1]) == -np.sign(slope) and model.weights[1] == model.weights[5]


def test_edges(spark):
    docs, labels = corpus(spark, 60)
    model = toxicity.learn(docs, labels)
    odd = spark.createDataFrame([(1, None, ""), (1, None, ""), (2, "", ""), (None, "idiot", ""), (3, "w1 " * 300_000, ""), (4, "日本 é", "")], DOCS)
    assert toxicity.grade(odd, model).count() == 6
    empty = spark.createDataFrame([], DOCS)
    nothing = toxicity.learn(empty, labels.limit(0))
    assert toxicity.grade(empty, model).count() == 0
    assert {r.grade for r in toxicity.grade(odd, nothing).collect()} == {0}
