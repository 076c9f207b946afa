from pyspark.sql import functions as F

from itinera.operators.clusters import label_photos, sessions
from itinera.plans import bridge
from itinera.streaming import ordered
from itinera.streaming import sessions as streams

DIR = "/root/testdata/sf0.001"


def run(spark, df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def photos(spark, tmp_path):
    rows = bridge.photos(spark, DIR).filter("us IS NOT NULL").withColumn("ts", F.timestamp_micros("us"))
    rows.repartition(1).write.parquet(str(tmp_path / "in"))
    return rows, spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))


def test_closed_sessions_are_those_of_the_batch(spark, tmp_path):
    batch, stream = photos(spark, tmp_path)
    got = {(r.owner, r.start, r["last"], r.n) for r in run(spark, streams.session_stream(stream), "closed").collect()}
    whole = sessions(batch).select("owner", F.timestamp_micros("start_us").alias("a"), F.timestamp_micros("end_us").alias("b"), "n")
    want = {(r.owner, r.a, r.b, r.n) for r in whole.collect()}
    assert got <= want and len(got) > 0.5 * len(want)


def test_stream_labels_equal_the_fold(spark, tmp_path):
    batch, stream = photos(spark, tmp_path)
    got = {(r.owner, r.photo_id): r.cluster for r in run(spark, streams.label_stream(stream), "labels").collect()}
    want = {(r.owner, r.photo_id): r.cluster for r in label_photos(batch).collect()}
    assert got == want


def test_daily_counts(spark, tmp_path):
    batch, stream = photos(spark, tmp_path)
    got = {(r.owner, r.start): r.n for r in run(spark, streams.daily_counts(stream), "days", "append").collect()}
    want = {(r.owner, r.d): r.n for r in batch.groupBy("owner", F.date_trunc("day", "ts").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got and all(want[k] == n for k, n in got.items())


def test_old_and_undated_photos(spark, tmp_path):
    """Times before 1970 split by gaps like any others, and photos without a time follow those with one."""
    day = 86_400_000_000
    rows = [(1, i, -1800 * day + i * day, 35.0, 33.0) for i in range(4)] + [(1, 9, None, 35.0, 33.0), (2, 1, None, 1.0, 1.0)]
    batch = spark.createDataFrame(rows, "owner long, photo_id long, us long, lat double, lon double")
    stored = batch.withColumn("ts", F.timestamp_micros("us")).repartition(1)
    stored.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(stored.schema).parquet(str(tmp_path / "in"))
    got = {(r.owner, r.photo_id): r.cluster for r in run(spark, streams.label_stream(stream), "old").collect()}
    assert got == {(1, 0): 0, (1, 1): 1, (1, 2): 2, (1, 3): 3, (1, 9): 3, (2, 1): 0}
    assert got == {(r.owner, r.photo_id): r.cluster for r in label_photos(batch).collect()}


def test_late_photos_are_put_in_order(spark, tmp_path):
    """Four micro-batches with photos up to 50 minutes late: the labels are those of the batch fold; idle owners are forgotten."""
    minute = 60_000_000
    rows = [(o, 1000 * o + i, 1_700_000_000_000_000 + (i * 97 + o) * minute, 35.0 + (i // 7) * 0.5, 33.0) for o in range(5) for i in range(60)]
    rows += [(9, 9000 + i, 1_700_000_000_000_000 + i * minute, 1.0, 1.0) for i in range(3)] + [(9, 9100, 1_700_000_000_000_000 + 5500 * minute, 1.0, 1.0)]
    rows += [(1, 8000, None, 35.0, 33.0), (1, 8001, 1_700_000_000_000_000, None, 33.0)]
    batch = spark.createDataFrame(rows, "owner long, photo_id long, us long, lat double, lon double")
    end = max(r[2] for r in rows if r[2])
    arrival = F.coalesce("us", F.lit(0)) + F.col("photo_id") % 50 * minute
    held = batch.withColumns({"part": F.least(F.lit(3), F.floor((arrival - 1_700_000_000_000_000) / (1500 * minute))), "ts": F.timestamp_micros("us")})
    for part in range(-2, 4):
        one = held.filter(held["part"] == part if part >= 0 else held["us"].isNull() & F.lit(part == -1)).drop("part", "us").coalesce(1)
        if not one.isEmpty():
            one.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(held.drop("part", "us").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with ordered.keyed_state(spark):
        got = {(r.owner, r.photo_id): r.cluster for r in run(spark, ordered.label_in_order(stream, idle_days=1), "ordered").collect()}
    passed = batch.filter(f"us < {end - 60 * minute}")
    want = {(r.owner, r.photo_id): r.cluster for r in label_photos(passed).collect()}
    want[9, 9100] = 0  # it was forgotten since
    assert got == want
