import __spark_entry__ as registry


def test_flagship(spark):
    df = registry.entry(spark)
    assert df.columns == ["alias", "canonical", "replacements", "texts_changed"]
    assert df.count() > 5


def test_every_sql_belongs_to_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_silent_keys_of_a_stream_share_states(spark, tmp_path, monkeypatch):
    """Events that come out are those of a state for each key; calls and states are of groups of keys."""
    import random
    from datetime import datetime, timedelta

    from pyspark.sql import functions as F

    from scribemend.streaming import transcripts as Y

    monkeypatch.setattr(Y, "BUCKETS", 8, raising=False)
    rng, start = random.Random(3), datetime(2024, 1, 1)
    rows = sorted(((start + timedelta(seconds=rng.randrange(400_000)), rng.choice([None, *range(60)]), rng.choice(["a", "b\"", "", None]))
                   for _ in range(3000)), key=lambda r: r[0])
    schema, path = "ts timestamp, user long, kind string", str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame(rows[k * 1000:(k + 1) * 1000], schema).coalesce(1).write.mode("append").parquet(path)
    stream = Y.once_within(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), ["user", "kind"], "ts", 40_000, "1 hour")
    assert stream.dtypes == [("user", "bigint"), ("kind", "string"), ("ts", "timestamp")]
    query = (stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    until, want = {}, []
    for at, *key in rows:
        if at >= until.get(tuple(key), at):
            want.append((*key, at))
            until[tuple(key)] = at + timedelta(seconds=40_000)
    got = spark.read.parquet(str(tmp_path / "out")).select("user", "kind", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((u, k, at.strftime("%Y-%m-%d %H:%M:%S")) for u, k, at in want), key=str)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 8


def test_parts_of_a_stream_are_read_by_many_tasks(spark, tmp_path):
    """A part is one file of small row groups."""
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from bindings.streams import _in_parts

    rows = spark.range(400_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.sha2(F.concat("id", F.lit(k)).cast("string"), 256) for k in range(2)]).alias("text"))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    path, _ = _in_parts(spark, str(tmp_path), "documents", F.lit(0), ["doc_id", "text"], str(tmp_path / "parts"), [0])
    files = list((tmp_path / "parts").glob("*.parquet"))
    assert len(files) == 1 and pq.ParquetFile(files[0]).num_row_groups >= 3
