"""Streams against batches: the anchor with late and missing ticks, the journal with broken and repeated batches."""

import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidemark.operators import journal
from tidemark.sources import bars as src
from tidemark.streaming import anchors as live
from tidemark.streaming import sink

TICK = "event_id bigint, ts timestamp, event_type string, value double"
SIGNAL = "date date, symbol string, prob double"


def files(spark, folder, batches, schema):
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{n}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def run(stream, out):
    query = stream.writeStream.option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start(f"{out}/rows", format="parquet")
    query.awaitTermination(300)
    return sorted(tuple(r) for r in stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/rows").collect())


def batch_anchors(spark, ticks):
    """The batch operator over the same ticks, for a session known to end at 16:00."""
    at = F.from_utc_timestamp("ts", src.ZONE)
    second = F.pmod(F.unix_seconds(at), F.lit(86_400))
    rows = ticks.select(F.col("event_type").alias("symbol"), F.to_date(at).alias("day"), second.alias("s"), "value", F.struct("ts", "event_id").alias("k"))
    bars = rows.where(F.col("s").between(src.OPENS, src.CLOSES)).groupBy("symbol", "day", (F.floor(F.col("s") / 1800) * 30).cast("int").alias("minute")).agg(
        F.min_by("value", "k").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "k").alias("close"), F.count("*").alias("volume")
    )
    return sorted(tuple(r) for r in src.anchors(bars, close=960).collect())


def tick(n, day, clock, value, symbol="S"):
    # New York in January is five hours behind UTC.
    return n, dt.datetime.combine(day, clock) + dt.timedelta(hours=5), symbol, value


def test_anchor_stream_equals_the_batch(spark, tmp_path):
    t, one, two, end = dt.time, dt.date(2024, 1, 9), dt.date(2024, 1, 10), dt.date(2024, 2, 1)
    first = [tick(k, one, t(9 + (30 + 20 * k) // 60, (30 + 20 * k) % 60), 100.0 + k) for k in range(17)]
    first += [tick(50 + k, one, t(10 + k), 50.0 + k, "T") for k in range(3)]  # nothing after noon
    first += [tick(60, one, t(11, 5), 9.0, "U"), tick(61, one, t(8, 0), 9.0, "U"), (62, None, "U", 1.0)]  # one bar: no anchor
    second = [tick(100, one, t(14, 10), 777.0, "T")]  # late, within the 90 minutes behind 15:00
    third = [tick(200 + k, two, t(10 + k), 200.0 + k) for k in range(6)] + [tick(210, two, t(16, 0), 300.0)]
    fourth = [tick(220, two, t(15, 50), 310.0)]  # a row comes out a batch after the watermark has passed it
    lost = [tick(300, one, t(14, 40), 1e6)]  # a day late
    last = [tick(400, end, t(12), 1.0)]
    batches = [first, second, third, fourth, lost, last]
    got = run(live.anchors(files(spark, str(tmp_path / "in"), batches, TICK)), str(tmp_path / "out"))
    want = batch_anchors(spark, spark.createDataFrame(first + second + third + fourth, TICK))
    assert got == want and [(r[0], r[1]) for r in got] == [("S", one), ("S", two), ("T", one)]
    assert got[2][2] == 777.0


def test_anchor_of_a_plain_table_and_of_none(spark):
    day = dt.date(2024, 7, 9)  # summer: four hours
    rows = [(k, dt.datetime(2024, 7, 9, 14 + k, 15), "S", float(k)) for k in range(6)]
    ticks = spark.createDataFrame(rows, TICK).withColumn("symbol", F.lit("clash"))
    assert [tuple(r) for r in live.anchors(ticks).collect()] == batch_anchors(spark, ticks) == [("S", day, 5.0, 6)]
    assert live.anchors(ticks.where("false")).collect() == []
    with pytest.raises(ValueError):
        live.anchors(ticks, minutes=37)


def signals(day, **probs):
    return [(dt.date(2024, 1, day), s, p) for s, p in probs.items()]


def test_journal_sink_survives_a_break_and_a_replay(spark, tmp_path):
    folder, progress = str(tmp_path / "journal"), str(tmp_path / "progress")
    batches = [signals(2, A=0.1, B=0.2) + signals(3, A=0.3), signals(3, A=0.4, B=0.5) + signals(4, A=0.6), signals(2, C=0.7)]
    stream = files(spark, str(tmp_path / "in"), batches, SIGNAL)
    write, broken = sink.writer(folder), []

    def breaks(batch, number):
        if number == 1 and not broken:
            # What a driver lost in the middle leaves: rows of another layout of the batch, and no line that they are whole.
            batch.unionByName(batch).write.parquet(f"{folder}/rows/batch=1")
            broken.append(number)
            raise RuntimeError("lost")
        write(batch, number)
        if number == 1:
            write(batch, number)

    def go():
        stream.writeStream.foreachBatch(breaks).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination(300)

    now = lambda **how: sorted(tuple(r) for r in sink.journal(spark, folder, SIGNAL, **how).collect())
    assert now() == []
    with pytest.raises(StreamingQueryException):
        go()
    assert broken == [1] and now() == sorted(batches[0])
    go()
    want = spark.createDataFrame([], SIGNAL)
    for rows in batches:
        want = journal.upsert(want, spark.createDataFrame(rows, SIGNAL))
    want = sorted(tuple(r) for r in want.collect())
    assert now() == want == sorted(batches[2] + batches[1])
    assert now(keep=1) == signals(4, A=0.6)
    by_row = now(unit=("date", "symbol"))
    assert by_row == sorted(signals(2, A=0.1, B=0.2, C=0.7) + batches[1])
    sink.compact(spark, folder, SIGNAL, unit=("date", "symbol"))
    sink.compact(spark, folder, SIGNAL, unit=("date", "symbol"))
    assert now(unit=("date", "symbol")) == by_row
    write(spark.createDataFrame(signals(4, A=0.9), SIGNAL), 3)
    assert now(unit=("date", "symbol")) == sorted([r for r in by_row if r[0].day != 4] + signals(4, A=0.9))


def test_journal_sink_on_odd_batches(spark, tmp_path):
    folder, schema = str(tmp_path), f"{SIGNAL}, ts int"
    write = sink.writer(folder, order="ts")
    write(spark.createDataFrame([], schema), 0)
    assert sink.journal(spark, folder, schema).collect() == []
    twice = [(*signals(2, A=p)[0], n) for n, p in enumerate((0.1, 0.2, 0.3))]
    write(spark.createDataFrame([*twice, (None, None, None, 1)], schema), 1)
    write(spark.createDataFrame([(None, "Z", 0.5, None)], schema), 2)
    got = {tuple(r) for r in sink.journal(spark, folder, schema).collect()}
    assert got == {twice[2], (None, "Z", 0.5, None)}
