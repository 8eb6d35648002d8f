"""Polls that die and come again, and outcomes that are filled as bars come in."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from chatterflow.operators import prices
from chatterflow.streaming import flows, polls

ROW = "item_id string, score long, seen long"


def land(spark, path, rows, kind=ROW):
    spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, kind=ROW):
    return spark.readStream.schema(kind).parquet(path)


def shown(table):
    return {r.item_id: (r.score, r.seen) for r in table.read().collect()}


@pytest.mark.parametrize("dies", ["before the write", "between write and entry", "after the entry"])
def test_a_poll_that_dies_is_made_once(spark, tmp_path, dies):
    landed, check = f"{tmp_path}/in", f"{tmp_path}/check"
    schema = spark.createDataFrame([], ROW).schema
    table = polls.UpsertTable(spark, f"{tmp_path}/table", schema, ["item_id"], "seen")
    land(spark, landed, [("a", 1, 1), ("b", 1, 1), ("a", 2, 2)])
    polls.poll(stream(spark, landed), table.upsert, check)
    assert shown(table) == {"a": (2, 2), "b": (1, 1)}
    land(spark, landed, [("b", 5, 3), ("c", 1, 3)])
    written = []

    def failing(rows, batch):
        if dies != "before the write":
            table.write(rows, batch)
        if dies == "after the entry":
            table.enter(batch)
        written.append(batch)
        raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        polls.poll(stream(spark, landed), failing, check)
    assert shown(table) == ({"a": (2, 2), "b": (5, 3), "c": (1, 3)} if dies == "after the entry" else {"a": (2, 2), "b": (1, 1)})
    again = []
    polls.poll(stream(spark, landed), lambda rows, batch: (again.append(batch), table.upsert(rows, batch)), check)
    assert again == written and shown(table) == {"a": (2, 2), "b": (5, 3), "c": (1, 3)}
    rows = table.versions().count()
    polls.poll(stream(spark, landed), table.upsert, check)  # nothing new
    assert table.versions().count() == rows == 5
    table.upsert(spark.createDataFrame([("z", 9, 9)], ROW), written[0])  # an entered batch under its id again
    assert shown(table) == {"a": (2, 2), "b": (5, 3), "c": (1, 3)}


def test_compaction_changes_nothing(spark, tmp_path):
    schema = spark.createDataFrame([], ROW).schema
    table = polls.UpsertTable(spark, f"{tmp_path}/table", schema, ["item_id"], "seen")
    assert shown(table) == {} and not table.has(0)
    draw, want = random.Random(3), {}
    for batch in range(6):
        rows = [(draw.choice("abcdefgh"), draw.randrange(100), 10 * batch + i) for i in range(5)]
        table.upsert(spark.createDataFrame(rows, ROW), batch)
        want |= {k: (s, t) for k, s, t in rows}
        if batch in (2, 4):
            table.compact()
        assert shown(table) == want
    assert table.has(1) and table.has(5) and not table.has(6)
    assert table.versions().count() < 30


EVENT, BAR = "signal_id string, ticker string, signal_time timestamp", "ticker string, bar_time timestamp, close double"


def test_late_bars_give_the_batch_result(spark, tmp_path):
    draw = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    day = lambda n: start + dt.timedelta(days=n)
    bars = [(t, day(n), float(draw.randrange(10, 99))) for t in "TU" for n in range(60) if n % 7 < 5 and not (t == "U" and n in range(20, 24))]
    events = [(f"e{i}", draw.choice("TUV"), day(draw.randrange(8)) + dt.timedelta(hours=draw.randrange(1, 20))) for i in range(12)]
    paths = [f"{tmp_path}/{x}" for x in ("events", "bars", "out", "check")]
    horizons = (1, 7, 14)

    def run():
        met = flows.bars_ahead(stream(spark, paths[0], EVENT), stream(spark, paths[1], BAR), 14)
        met.writeStream.format("parquet").option("path", paths[2]).option("checkpointLocation", paths[3]).trigger(availableNow=True).outputMode("append").start().awaitTermination()
        return {r.signal_id: tuple(r[f"return_{h}d"] for h in horizons) for r in flows.returns_so_far(spark.read.parquet(paths[2]), horizons).collect()}

    e, p = spark.createDataFrame(events, EVENT), spark.createDataFrame(bars, BAR)
    batch = prices.calendar_returns(e.withColumn("day", F.col("signal_time").cast("date")), p.select("ticker", F.col("bar_time").cast("date").alias("date"), "close"), "signal_id", "day", horizons)
    want = {r.signal_id: tuple(r[f"return_{h}d"] for h in horizons) for r in batch.collect()}
    land(spark, paths[0], events, EVENT)
    early = sorted((b for b in bars if b[1] <= day(12)), key=lambda b: draw.random())
    held_back = [b for b in early if b[1] > day(10)][:2]  # late, but within two days
    land(spark, paths[1], [b for b in early if b not in held_back], BAR)
    before = run()
    assert any(a is None and b is not None for name in before for a, b in zip(before[name], want[name], strict=True))
    land(spark, paths[1], held_back, BAR)
    run()
    land(spark, paths[1], [b for b in bars if b[1] > day(12)] + [("Z", day(80), 1.0)], BAR)
    land(spark, paths[0], [("far", "Z", day(80))], EVENT)
    run()
    land(spark, paths[0], [("end", "Z", day(90))], EVENT)
    land(spark, paths[1], [("Z", day(90), 1.0)], BAR)
    after = run()
    assert {k: v for k, v in after.items() if k not in ("far", "end")} == want
    rows = spark.read.parquet(paths[2]).filter("ticker = 'V'").collect()
    assert len(rows) == sum(t == "V" for _, t, _ in events) and all(r.close is None for r in rows)
