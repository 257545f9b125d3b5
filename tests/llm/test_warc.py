import hashlib
import io
import random

from contextlake.llm import warc

SCHEMA = "page_id long, url string, html string, digest string"


def brute(rows):
    out = []
    for i, _, html, _ in rows:
        data = (html or "").encode()
        same = [j for j, _, h, _ in rows if (h or "") == (html or "") and j is not None]
        revisit = len(data) >= 1000 and i is not None and max(same) != i
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None))
    return out


def pages():
    rng = random.Random(6)
    bodies = ["<p>" + "é" * rng.randrange(300, 700) + "</p>" for _ in range(12)] + ["", "short", "x" * 999, "x" * 1000, "y\r\n\r\nWARC/1.1\r\n" * 100]
    rows = [(i, f"http://a.example/{i}", rng.choice(bodies), "d") for i in range(400)]
    return rows + [(500, None, None, None), (501, "http://x\r\ny: z", "q" * 3_000_000, None), (None, "u", bodies[0], None), (502, "u", bodies[1], None), (502, "u", bodies[1], None)]


def test_round_trip(spark):
    rows = pages()
    index = warc.write(spark.createDataFrame(rows, SCHEMA).repartition(4))
    got = [tuple(r) for r in warc.read(index).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
    html = {i: h or "" for i, _, h, _ in rows}
    kinds = {r[0]: r[3] for r in got}
    for r in index.collect():
        if r.page_id is not None and kinds[r.page_id] == "response":
            head, body = warc.fetch(r.path, r.frame, r.offset, r.length)
            assert head["WARC-Record-ID"] == f"<urn:page:{r.page_id}>"
            assert body.split(b"\r\n\r\n", 1)[1].decode() == html[r.page_id]


def test_frames_are_independent_and_standard():
    import zstandard

    sink = io.BytesIO()
    sink.close, whole = (lambda: None), b""
    writer = warc.BundleWriter(sink, frame_bytes=100)
    places = []
    for i in range(30):
        data = bytes([65 + i % 26]) * (i * 7 % 60 + 1)
        places.append((*writer.add(data), data))
        whole += data
    writer.close()
    raw = sink.getvalue()

    class Source(io.BytesIO):
        def size(self):
            return len(raw)

    reader = warc.BundleReader(Source(raw))
    assert len(reader) > 5
    for frame, offset, data in places:
        assert reader.frame(frame)[offset : offset + len(data)] == data
    stream = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True)
    assert stream.read() == whole


def test_no_pages(spark):
    assert warc.read(warc.write(spark.createDataFrame([], SCHEMA))).count() == 0
