import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from contextlake.llm import packing, textbuf

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")

ODD = ["a  b c \n d  　e\n\n f <|endoftext|> don't  'll x's   y", " ", "", "\n", "  a  ", "é è  é", "日本語 テキスト  　あ", "x y", "a\x00b \x01c", "1 22  333 , . !! 4x"]
END = "<|endoftext|>"
ODD += [END, f"a {END} b", f"a  {END}  b", END * 3, f"{END}<|endof", f"text|> x\n\n {END}\n", f"'{END}s é{END}é"]


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_ids_equal_the_tokenizer():
    rng = random.Random(4)
    alphabet = [*"ab é\n\t .,'s1日\xa0 　😀-_", END]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)]
    data = b"".join(t.encode() for t in texts)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    enc = packing.Encoder(PATH)
    for _ in range(2):  # the second time from the cache
        ids, rows = enc.block(np.frombuffer(data, np.uint8), offsets)
        assert [ids[rows[i] : rows[i + 1]].tolist() for i in range(len(texts))] == reference_ids(texts)


def test_ids_without_ranks(tmp_path):
    """The tokenizer file alone gives the same ids."""
    (tmp_path / "v.json").write_bytes(open(PATH, "rb").read())
    data = b"".join(t.encode() for t in ODD)
    offsets = np.cumsum([0, *(len(t.encode()) for t in ODD)])
    ids, rows = packing.Encoder(str(tmp_path / "v.json")).block(np.frombuffer(data, np.uint8), offsets)
    assert [ids[rows[i] : rows[i + 1]].tolist() for i in range(len(ODD))] == reference_ids(ODD)


def test_best_fit_takes_the_fullest_bin_and_closes_the_fullest():
    bins = packing.Bins(10, 2)
    assert bins.place(6) == (0, 0)
    assert bins.place(7) == (1, 0)
    assert bins.place(3) == (1, 7)  # 3 left in bin 1 fits exactly, bin 0 has 4
    assert bins.place(8) == (2, 0)
    assert bins.place(9) == (3, 0)  # bin 2 is the fullest and closes
    assert bins.place(2) == (0, 6)
    assert bins.place(2) == (0, 8)


def test_round_trip(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "γ", "x9", "\n"]) for _ in range(rng.choice([0, 3, 50, 400, 3000]))), "s") for i in range(120)]
    rows += [(500, None, None), (500, "twice", "s"), (500, "twice", "s"), (None, "no id", "s"), (501, "z" * 400_000, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string")
    out = packing.packed_documents(docs, PATH, with_ids=True).collect()
    by_doc = {}
    for r in out:
        assert 1 <= r.length <= 1024 and len(r.ids) == r.length
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert r.piece == 0 or r.length == 1024
        by_doc.setdefault(r.doc_id, []).append(r)
    texts = {i: t or "" for i, t, _ in rows if i not in (500, None)}
    for (i, _), ids in zip(texts.items(), reference_ids(texts.values()), strict=True):
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert sum((list(r.ids) for r in own), []) == [*ids, 2]
        assert all(r.start == sum(x.length for x in own[: r.piece]) for r in own)
    assert len(by_doc[500]) == 3 and len(by_doc[None]) == 1
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024


def test_no_documents(spark):
    assert packing.packed_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_blocks_keep_rows_and_nulls():
    import pyarrow as pa

    column = pa.array(["ab", None, "", "c" * 10, "d"]).slice(1)
    seen = [(i, j, bytes(d), o.tolist()) for i, j, d, o in textbuf.blocks(column, limit=4)]
    assert seen == [(0, 2, b"", [0, 0, 0]), (2, 3, b"c" * 10, [0, 10]), (3, 4, b"d", [0, 1])]


def test_a_worker_keeps_no_parts_after_a_task():
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some words that are kept meanwhile"])], ["id", "text"])
    assert [b.column("length").to_pylist() for b in packing._tokenised([batch], PATH, 2, 1024, False)] == [[len(reference_ids(["some words that are kept meanwhile"])[0]) + 1]]
    assert not packing.encoder(PATH).slot and not len(packing.encoder(PATH).ids)


def test_parts_kept_in_a_task_are_few():
    """Beyond some ten thousand parts the cache gave no time, only memory."""
    words = [f"{i:x}" for i in range(1 << 16, 1 << 18)]
    texts = [" ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    kept = [len(packing.encoder(PATH).slot) for _ in packing._tokenised([batch], PATH, 2, 1024, False)]
    assert 10_000 < max(kept) < 150_000


def test_batches_to_python_are_bounded_by_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])

    docs = spark.range(0, 60, 1, 1).selectExpr("id as doc_id", "repeat('ab ', if(id = 7, 3000000, 100000)) as text")
    before = spark.conf.get(textbuf.BATCH_KEY, None)
    try:
        spark.conf.unset(textbuf.BATCH_KEY)
        packing.pieces(docs, PATH)  # what the stages set holds for the plans that run later
        got = docs.mapInArrow(sizes, "n long, bytes long").collect()
        assert sum(r.n for r in got) == 60 and len(got) >= 5
        assert all(r.bytes < 2 * textbuf.BATCH_BYTES or 8e6 < r.bytes < 1.4e7 for r in got)
        spark.conf.set(textbuf.BATCH_KEY, str(1 << 20))
        textbuf.mapped(docs, sizes, "n long, bytes long")
        assert spark.conf.get(textbuf.BATCH_KEY) == str(1 << 20)
    finally:
        spark.conf.unset(textbuf.BATCH_KEY) if before is None else spark.conf.set(textbuf.BATCH_KEY, before)
