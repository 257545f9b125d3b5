import random

import corpus_pipeline
from contextlake.llm import pii, queries
from tests.llm.test_neardup import brute
from tests.llm.test_pii import brute as base_spans

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the house and garden of that man with them were under over each morning river stone".split(), "de": "das haus und der garten dieser frau nicht für straße zwischen über unter morgen fluss stein".split()}


def documents():
    rng = random.Random(8)
    rows = []
    for i in range(60):
        lang = rng.choice(["en", "de"])
        text = " ".join(rng.choice(WORDS[lang]) for _ in range(rng.choice([5, 40, 200])))
        rows.append((i, text, lang if i % 5 else None, rng.choice(["a", "b", None]), len(text)))
    for i in range(60, 90):
        j = rng.randrange(60)
        text = rows[j][1] + (f" und mail a{i}@b.example.org the" if i % 3 else "")
        rows.append((i, text, rows[j][2], rows[j][3], len(text)))
    return rows + [(100, None, "en", "a", 0), (101, "", "en", "a", 0), (102, "12 34 !!", "de", "b", 8)]


def test_stages_equal_a_plain_version(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        seen[name] = docs.collect()
        if i < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
    assert names == ["language_id", "near_dedup", "pii", "mixing", "packing"]
    assert {r.doc_id for r in seen["language_id"]} == {r[0] for r in rows} - {100, 101, 102}
    assert all(r.lang for r in seen["language_id"])
    text = {r[0]: r[1] for r in rows}
    kept = {i for i, _, _, k in brute([(r.doc_id, r.text) for r in seen["language_id"]], width=5) if k}
    assert {r.doc_id for r in seen["near_dedup"]} == kept
    for r in seen["pii"]:
        want, at = "", 0
        for s, _, e, k in base_spans(text[r.doc_id]):
            want, at = want + text[r.doc_id][at:s] + f"<{k}>", e
        assert r.text == want + text[r.doc_id][at:] and r.n_chars == len(r.text)
    assert "email" in pii.KINDS and any("<email>" in r.text for r in seen["pii"])
    copies = {}
    for r in seen["mixing"]:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert set(copies) <= kept and max(copies.values()) <= 2 and len(seen["mixing"]) > len(kept)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    ids = {r.doc_id: len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in seen["pii"]}
    assert sum(r.length for r in seen["packing"]) == sum(n * ids[i] for i, n in copies.items())
    whole = corpus_pipeline.run(spark, str(tmp_path)).drop("sequence_id", "offset").collect()
    assert sorted(map(str, whole)) == sorted(str(r) for r in spark.read.parquet(f"{tmp_path}/4").drop("sequence_id", "offset").collect())


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_language_id_rejects_scripts_it_has_not_learned(spark):
    rng = random.Random(5)
    scripts = [(0x430, 0x450), (0x3B1, 0x3C2), (0x5D0, 0x5EB), (0x627, 0x63B), (0x905, 0x93A), (0xAC00, 0xD7A4), (0x4E00, 0x9FA6)]
    rows = documents() + [(200, "Garden.", None, "a", 7), (201, "Garten", None, "a", 6)]
    for i, (lo, hi) in enumerate(scripts * 10):
        text = " ".join("".join(chr(rng.randrange(lo, hi)) for _ in range(rng.randrange(2, 9))) for _ in range(60))
        rows.append((300 + i, text, None, "a", len(text)))
    kept = {r.doc_id for r in corpus_pipeline.identify(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert kept == {r[0] for r in rows if r[0] < 300} - {100, 101, 102}
