import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from contextlake.llm import chroma

SCHEMA = "doc_id long, samples binary, offset string"


def melody(seed, n=9000):
    rng = np.random.default_rng(seed)
    t = np.arange(n) / chroma.RATE
    out = np.zeros(n)
    for at in range(0, n, 600):
        note = 440 * 2 ** (rng.integers(0, 24) / 12)
        out[at : at + 600] += np.sin(2 * np.pi * note * t[at : at + 600])
    return np.clip(128 + 60 * out + rng.normal(0, 1, n), 0, 255).astype(np.uint8)


def brute(prints, queries, worst=0.12, least=8):
    found = {}
    for q in queries:
        for c, p in prints.items():
            if c != q:
                tries = [chroma.bit_error(prints[q], p, o) for o in range(-len(prints[q]) + least, len(p) - least + 1)]
                if any(f >= least and e <= worst for f, e in tries if f >= 0.5 * min(len(prints[q]), len(p))):
                    found[q, c] = True
    return set(found)


def test_recall_against_brute_force(spark):
    recordings = {}
    for i in range(30):
        base = melody(i // 3)
        part = base[64 * (i % 3) * 10 :]
        noise = np.random.default_rng(i).integers(-2, 3, len(part))
        recordings[i] = np.clip(part.astype(int) + (noise if i % 3 else 0), 0, 255).astype(np.uint8)
    rows = [(i, x.tobytes(), "o") for i, x in recordings.items()]
    rows += [(100, recordings[1].tobytes(), None), (101, None, "o"), (102, b"", "o"), (103, b"\x80" * 5000, "o"), (None, recordings[0].tobytes(), "o"), (104, b"\x80" * 300, "o")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    members, matches = chroma.align(df, F.col("doc_id") % 5 == 0)
    names = {r.id: r.class_id for r in members.collect() if r.id is not None}
    assert names[100] == 1 and names[101] == 101 and names[104] == 104 and len(names) == 35
    prints = {i: chroma.fingerprint(chroma.chroma(x)) for i, x in recordings.items()}
    queries = [i for i in prints if i % 5 == 0] + [1]
    want = brute(prints, queries)
    got = {(r.query_id, r.match_id): r for r in matches.collect()}
    assert len(want) >= 12 and len(want & got.keys()) >= 0.9 * len(want)
    for (q, c), r in got.items():
        if c in prints and q in prints:
            assert (r.frames, r.bit_error) == chroma.bit_error(prints[q], prints[c], r.offset) and r.bit_error <= 0.12
            assert q // 3 == c // 3 and r.offset == 10 * (q % 3 - c % 3)


def test_integral_image_equals_plain_sums():
    frames = chroma.chroma(melody(1, 3000))
    got = chroma.fingerprint(frames)
    assert len(got) == len(frames) - chroma.LENGTH + 1
    for t in (0, 3, len(got) - 1):
        packed = 0
        for kind, y, h, w in chroma.filters():
            assert y + h <= 12
            x = frames[t : t + w].astype(float)
            if kind == 0:
                one, two = x[:, y : y + h].sum() * 12 / h, x.sum()
            elif kind == 1:
                one, two = x[:, y : y + h // 2].sum(), x[:, y + h // 2 : y + 2 * (h // 2)].sum()
            else:
                one, two = x[: w // 2, y : y + h].sum(), x[w // 2 :, y : y + h].sum()
            level = np.log((one + 0.01) / (two + 0.01))
            packed = packed << 2 | int(chroma.GRAY[sum(level > c for c in chroma.CUTS)])
        assert bin(packed ^ int(got[t])).count("1") <= 1


def test_no_recordings(spark):
    members, matches = chroma.align(spark.createDataFrame([], SCHEMA), F.col("doc_id") % 50 == 0)
    assert members.count() == 0 and matches.count() == 0


def test_a_long_query_meets_all_its_clips(spark):
    base = np.random.default_rng(3).integers(97, 123, 62_000).astype(np.uint8)
    rows = [(50, base.tobytes(), None)] + [(51 + i, base[1536 * i : 1536 * (i + 1)].tobytes(), None) for i in range(40) if (51 + i) % 50]
    _, matches = chroma.align(spark.createDataFrame(rows, SCHEMA), F.col("doc_id") == 50)
    assert {(r.match_id, r.offset, r.bit_error) for r in matches.collect()} == {(i, -24 * (i - 51), 0.0) for i, _, _ in rows[1:]}


def test_a_repeated_passage_is_aligned_at_every_place(spark):
    rng = np.random.default_rng(5)
    x, y, z = (rng.integers(97, 123, n).astype(np.uint8) for n in (5760, 4480, 3200))
    rows = [(50, np.concatenate([x, y, x, z]).tobytes(), None), (51, np.concatenate([x, z]).tobytes(), None), (52, np.concatenate([x, y]).tobytes(), None)]
    _, matches = chroma.align(spark.createDataFrame(rows, SCHEMA), F.col("doc_id") == 50)
    assert {(r.match_id, r.offset, r.bit_error) for r in matches.collect()} == {(51, -160, 0.0), (52, 0, 0.0)}


def test_silence_gives_bounded_offsets():
    flat = np.full(3000, 7, "<u4").tobytes()
    assert len(chroma.offsets(flat, flat)) == 2 * 2993 - 1 and chroma.offsets(flat, flat)[0] == 0


def test_short_recordings_are_linked(spark):
    rng = np.random.default_rng(9)
    base, other = (rng.integers(97, 123, n).astype(np.uint8) for n in (6000, 900))
    rows = [(50, base.tobytes(), None), (51, base[1280:2180].tobytes(), None), (52, other.tobytes(), None), (53, b"a few words", None), (54, b"a few words", None), (55, b"a few wordz", None), (56, None, None), (57, b"", None)]
    members, matches = chroma.align(spark.createDataFrame(rows, SCHEMA), F.col("doc_id") == 50)
    assert dict(map(tuple, members.collect())) == {50: 50, 51: 51, 52: 52, 53: 53, 54: 53, 55: 55, 56: 56, 57: 57}
    assert [tuple(r) for r in matches.collect()] == [(50, 51, -20, 4, 0.0)]


def test_other_samples_are_not_alike():
    x = np.random.default_rng(2).integers(97, 123, 704).astype(np.uint8)
    assert chroma.likeness(x, x, 0) > 0.99 and chroma.likeness(x, x[::-1], 0) < 0.9


def plain(queries, others, worst=0.12, least=8):
    """Matches pair by pair, offset by offset."""
    out = set()
    for q, a in queries.items():
        for c, b in others.items():
            met = q != c and np.isin(chroma._places(a)[1], chroma._places(b)[1]).any() or min(len(a), len(b)) < 4 * chroma.NEIGHBOURS
            for rank, o in enumerate(chroma.offsets(a, b) if q != c and met else []):
                frames, error = chroma.bit_error(np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4"), o)
                need = min(least, len(a) // 4, len(b) // 4)
                if frames >= need and error <= worst:
                    out.add((q, c, o, frames, rank, error))
                    if need == least:
                        break
    return out


def test_a_cell_equals_a_plain_version(monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**32, 400).astype("<u4")
    rows = {}
    for i in range(60):
        n, at = int(rng.choice([1, 3, 7, 8, 30, 90])), int(rng.integers(0, 300))
        rows[i] = base[at : at + n] ^ (rng.random(n) < 0.1 * (i % 3)).astype("<u4") * np.uint32(1 << i % 31)
    rows |= {60: np.full(40, 9, "<u4"), 61: np.full(70, 9, "<u4"), 62: np.tile(base[:5], 12), 63: np.concatenate([base[:20], base[300:330], base[:20]])}
    rows = {i: p.astype("<u4").tobytes() for i, p in rows.items()}
    queries = {i: p for i, p in rows.items() if i % 3 == 0}

    def batch(query, found, cell):
        return pa.RecordBatch.from_arrays([pa.array([cell] * len(found), pa.int32()), pa.array([query] * len(found), pa.bool_()), pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], ["cell", "query", "name", "prints"])

    whole = pa.Table.from_batches([batch(True, queries, 1), batch(False, rows, 1), batch(False, rows, 2), batch(True, {63: rows[63]}, 3), batch(False, rows, 3)]).combine_chunks()
    want = sorted([*plain(queries, rows), *plain({63: rows[63]}, rows)])
    assert len({(q, c) for q, c, *_ in want}) > 100
    for hits, gather in ((1 << 20, 1 << 20), (64, 32), (1, 1)):
        monkeypatch.setattr(chroma, "HITS", hits)
        monkeypatch.setattr(chroma, "GATHER", gather)
        got = [tuple(r.values()) for b in chroma._aligned(whole.to_batches(max_chunksize=17), 0.12, 8) for r in b.to_pylist()]
        assert sorted(got) == want


def test_pairs_by_chance_are_not_written(spark, monkeypatch):
    rng = np.random.default_rng(8)
    common = rng.integers(97, 123, 1500)
    rows = [(i, np.concatenate([rng.integers(97, 123, 64 * (i % 7 + 40)), common, rng.integers(97, 123, 4000)]).astype(np.uint8).tobytes(), None) for i in range(60)]
    written, table = [], chroma.scratch.table
    monkeypatch.setattr(chroma.scratch, "table", lambda df, name: written.append(out := table(df, name)) or out)
    monkeypatch.setattr(chroma.scratch, "sweep", lambda paths=None: None)
    _, matches = chroma.align(spark.createDataFrame(rows, SCHEMA), F.col("doc_id") % 2 == 0)
    assert matches.count() == 0
    assert max(t.count() for t in written) == len(rows)


def test_a_grid_of_several_cells_gives_the_same(spark, monkeypatch):
    recordings = [(i, melody(i // 3)[64 * (i % 3) :].tobytes(), None) for i in range(24)]
    df = spark.createDataFrame(recordings, SCHEMA)
    one = sorted(map(tuple, chroma.align(df, F.col("doc_id") % 2 == 0)[1].collect()))
    monkeypatch.setattr(chroma, "QUERY_BYTES", 1500)
    monkeypatch.setattr(chroma, "PART_BYTES", 700)
    assert len(one) == 24 and sorted(map(tuple, chroma.align(df, F.col("doc_id") % 2 == 0)[1].collect())) == one


def test_a_stretch_gives_the_likeness_of_the_whole(spark):
    rng, rows = np.random.default_rng(12), []
    base = rng.integers(0, 256, 12_000).astype(np.uint8)
    while len(rows) < 80:
        a, b = int(rng.integers(704, 1152)), int(rng.integers(704, 5000))
        a, b = (a, b) if len(rows) % 2 else (b, a)
        na, nb = (len(chroma.fingerprint(chroma.chroma(base[:n]))) for n in (a, b))
        offset = int(rng.integers(-na, nb + 1))
        frames = min(na, nb - offset) - max(0, -offset)
        if frames == min(na, nb) < 8:
            at = 5000 - offset * chroma.HOP + int(rng.integers(-40, 41))
            rows.append((base[5000 : 5000 + a].tobytes(), base[at : at + b].tobytes(), offset, frames, max(0, -offset), max(0, offset)))
    df = spark.createDataFrame(rows, "a binary, b binary, offset long, frames long, ahead long, behind long")
    cut = df.select("a", "b", "offset", *(chroma.stretch(F.col(x), F.col(h), F.col("frames")).alias("s" + x) for x, h in (("a", "ahead"), ("b", "behind"))), (chroma._cut_at(F.col("ahead")) - chroma._cut_at(F.col("behind"))).alias("moved"))
    for r in cut.collect():
        a, b, x, y = (np.frombuffer(v, np.uint8) for v in (r.a, r.b, r.sa, r.sb))
        assert chroma.likeness(a, b, r.offset) == chroma.likeness(x, y, r.offset, r.moved)


def test_of_long_samples_only_a_stretch_is_moved(spark, monkeypatch):
    def weighed(batches, alike):
        for b in batches:
            moved = [float(len(x) + len(y)) for x, y in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist(), strict=True)]
            names = ["query_id", "match_id", "offset", "frames", "rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(moved)], [*names, "bit_error"])

    base = np.random.default_rng(3).integers(97, 123, 62_000).astype(np.uint8)
    rows = [(i, base.tobytes() if i == 50 else base[1280 * (i - 45) :][:900].tobytes(), None) for i in range(50, 61)]
    rows += [(100, base[1280:2180].tobytes(), None), (101, base[:40_000].tobytes(), None)]
    monkeypatch.setattr(chroma, "_alike", weighed)
    _, matches = chroma.align(spark.createDataFrame(rows, SCHEMA), F.col("doc_id") % 50 == 0)
    moved = [r.bit_error for r in matches.collect() if r.frames < 8]
    assert len(moved) >= 12 and max(moved) < 3000


def test_short_queries_are_heard_in_the_first_pass(spark, monkeypatch):
    rng = np.random.default_rng(21)
    base = rng.integers(97, 123, 20_000).astype(np.uint8)
    rows = [(i, base[1280 * i :][:900].tobytes(), None) for i in range(10)] + [(29, base[:5000].tobytes(), None), (30, base[1280:2180].tobytes(), None)]
    rows += [(i, np.concatenate([rng.integers(97, 123, 64 * (i % 7)), base, rng.integers(97, 123, 640)]).astype(np.uint8).tobytes(), None) for i in range(100, 112)]
    rows += [(200, rows[-1][1], None), (201, base[1280:2180].tobytes(), None), (None, base.tobytes(), None), (None, base[:800].tobytes(), None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    written, table = {}, chroma.scratch.table
    monkeypatch.setattr(chroma.scratch, "table", lambda df, name: written.update({name: table(df, name)}) or written[name])
    monkeypatch.setattr(chroma.scratch, "sweep", lambda paths=None: None)
    query = (F.col("doc_id") < 4) | (F.col("doc_id") > 200)
    got = sorted(map(tuple, chroma.align(df, query)[1].collect()))
    assert written["tried"].count() == 0 and len(got) >= 4 * 12 and {q for q, *_ in got} == {0, 1, 2, 3}
    written.clear()
    monkeypatch.setattr(chroma, "CLIP_BYTES", 10)
    assert sorted(map(tuple, chroma.align(df, query)[1].collect())) == got and written["tried"].count() >= len(got)
