import pyspark.sql.functions as F

from lumispark.operators.tracks import first_crossings
from lumispark.streaming.crossings import crossing_events, windowed_brightness


def test_crossings_of_a_stream_equal_the_batch(spark, tmp_path):
    cells = {1: (3, 2), 2: (2, 2), 3: (None, 1), 4: (None, None), 5: (0, 4)}
    schema = "identifier string, frame int, label int, mean_av double, mean_pi double"
    for f in range(5):
        rows = [("m", f, k, 1.0 if av is not None and f >= av else 0.1, 1.0 if pi is not None and f >= pi else 0.1) for k, (av, pi) in cells.items()]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{f}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = crossing_events(stream, 0.7, 0.3).writeStream.format("memory").queryName("crossed").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.label, r.stain): r.frame for r in spark.table("crossed").collect()}
    batch = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    want = {}
    for r in first_crossings(batch, ["identifier", "label"], F.col("mean_av"), F.col("mean_pi"), 0.7, 0.3).collect():
        want |= {(r.label, s): v for s, v in (("av", r.av_frame), ("pi", r.pi_frame)) if v is not None}
    assert got == want == {(1, "av"): 3, (1, "pi"): 2, (2, "av"): 2, (3, "pi"): 1, (5, "av"): 0}


def test_windows_leave_late_rows_out(spark, tmp_path):
    schema = "ts timestamp, label int, v double"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    out = windowed_brightness(stream, "ts", "v", ["label"], "5 minutes", "10 minutes")
    query = out.writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        for k, (ts, v) in enumerate([("00:01:00", 1.0), ("01:00:00", 5.0), ("00:02:00", 9.0), ("03:00:00", 2.0), ("03:01:00", 2.0)]):
            (tmp_path / "in" / f"{k}.json").write_text('{"ts": "2024-01-01T%sZ", "label": 1, "v": %s}' % (ts, v))
            query.processAllAvailable()
    finally:
        query.stop()
    assert sorted((r.n, r.mean) for r in spark.table("windows").collect()) == [(1, 1.0), (1, 5.0)]
