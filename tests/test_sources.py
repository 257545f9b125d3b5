from pyspark.sql import functions as F

from contextlake.sources import files
from contextlake.streaming import session


def test_read_files(spark, tmp_path):
    for path, body in {"a.ts": "x", "b/c.py": "é", "node_modules/d.js": "no", "b/out/e.go": "no", "f.txt": "no"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(body)
    got = {tuple(r) for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got == {("a.ts", 1, "x"), ("b/c.py", 2, "é")}
    assert [r.rel_path for r in files.read_files(spark, str(tmp_path), most=1).collect()] == ["a.ts"]


def test_index_round_trip(spark, tmp_path):
    index = spark.createDataFrame([("p", "t", "m")], "path string, text string, model_id string")
    files.write_index(index, f"{tmp_path}/i")
    files.write_index(index, f"{tmp_path}/i")
    assert [tuple(r) for r in files.read_index(spark, f"{tmp_path}/i").select("path", "text", "model_id").collect()] == [("p", "t", "m")]


def test_streamed_savings(spark, tmp_path):
    rows = [(1, "2024-01-01 00:01:00", 5), (1, "2024-01-01 00:09:00", 7), (1, "2024-01-01 00:02:00", -3), (2, "2024-01-01 00:15:00", 2)]
    entries = spark.createDataFrame(rows, "session long, ts string, tokens_saved long").withColumn("ts", F.to_timestamp("ts"))
    entries.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(entries.schema).parquet(f"{tmp_path}/in")
    q = session.windowed_savings(stream).writeStream.outputMode("complete").format("memory").queryName("savings").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.session, r.tokens_saved, r.optimizations) for r in spark.table("savings").collect()} == {(1, 12, 2), (2, 2, 1)}
