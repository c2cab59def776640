"""The stream's rate limit and cadence against the batch operators, with rows out of order and a restart."""

import random

import pytest
from pyspark.sql import functions as F

from plumeline.operators import records, tracks
from plumeline.streaming import spaced

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    yield spark
    spark.conf.set(name, before)


def told(spark, source, schema, make, out, check):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    make(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination(150)


def test_limit_equals_the_batch_over_a_restart(rocks, tmp_path):
    spark, draw = rocks, random.Random(5)
    schema = "client long, at_s double, n long, accepted string"
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    every = []
    for part in range(4):
        base = part * 90
        rows = [(draw.choice([None, 1, 2, 2**60 + 1]), base + draw.randint(0, 720) / 8 - draw.choice([0, 20]), i if i % 5 else None, "old") for i in range(120)]
        every += rows
        df = spark.createDataFrame(rows + ([(7, None, 1, "")] if part == 0 else []), schema).coalesce(1)
        df.withColumn("ts", F.timestamp_seconds(F.col("at_s") + 1.7e9)).write.mode("append").parquet(source)
        if part in (1, 3):
            if part == 3:  # a hit far ahead takes the watermark past all others
                spark.createDataFrame([(0, 1e5, 0, "")], schema).coalesce(1).withColumn("ts", F.timestamp_seconds(F.col("at_s") + 1.7e9)).write.mode("append").parquet(source)
            told(spark, source, schema + ", ts timestamp", lambda s: spaced.limited(s, late="3 minutes"), out, check)
    got = spark.read.parquet(out).where("client is distinct from 0")
    want = records.limited(spark.createDataFrame([*every, (7, None, 1, "")], schema))
    key = ["client", "at_s", "n", "accepted"]
    rows = lambda df: sorted(map(repr, map(tuple, df.select(*key).collect())))
    assert rows(got) == rows(want) and got.where("not accepted").count() > 30


def test_thinning_equals_the_batch(rocks, tmp_path):
    spark, draw = rocks, random.Random(6)
    schema = "mmsi string, s double, lon double"
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    rows = [(draw.choice([None, "a", "b"]), draw.randint(0, 6000) / 10, draw.random()) for _ in range(200)]
    for part in (rows[:100], [*rows[100:], ("a", None, 0.0)], [("end", 1e5, 0.0)]):
        spark.createDataFrame(part, schema).coalesce(1).withColumn("ts", F.timestamp_seconds(F.col("s") + 1.7e9)).write.mode("append").parquet(source)
    told(spark, source, schema + ", ts timestamp", lambda s: spaced.thinned(s, 15.0), out, check)
    want = tracks.thin_by_cadence(spark.read.parquet(source), 15.0).where("mmsi is distinct from 'end'")
    rows = lambda df: sorted(map(repr, map(tuple, df.select("mmsi", "s", "lon").collect())))
    got = rows(spark.read.parquet(out))
    assert got == rows(want) and 60 < len(got) < 200
