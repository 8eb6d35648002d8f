"""Operators on small hand-written tables, properties, storage and streaming."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatterflow.functions import lexicons as lex
from chatterflow.operators import classify, cooldown, corpus, mentions, prices, stats
from chatterflow.schema import conform_items
from chatterflow.sources import feeds, storage
from chatterflow.streaming import flows

UTC = dt.timezone.utc


def day(n):
    return dt.date(2024, 1, n)


def test_items_conform(spark):
    got = conform_items(spark.createDataFrame([("a", "7", None), (None, "1", "x")], "item_id string, score string, body_text string")).collect()
    assert len(got) == 1 and got[0].score == 7 and got[0].body_text == "" and got[0].item_type == "post"


def test_fallback_classifier(spark):
    items = spark.createDataFrame(
        [("", "undervalued with revenue growth and upside", ["X"], ["X Co"]), ("", "risk of dilution, to the moon, next tesla", ["Y"], None), ("", "hello", [], [])],
        "thread_title string, body_text string, tickers array<string>, company_names array<string>",
    )
    a, b, c = classify.fallback(items).collect()
    assert (a.sentiment, a.evidence_quality, a.confidence) == ("bullish", "medium", 0.45) and a.bull_case and not a.bear_case
    assert b.sentiment == "bearish" and "pump language" in b.red_flags and "comparison hype" in b.red_flags
    assert (c.sentiment, c.confidence, c.red_flags) == ("irrelevant", 0.35, ["fallback classifier", "unknown ticker/company"])


def test_model_answers_are_normalised(spark):
    rows = [('{"sentiment":"Bullish","confidence":7,"tickers":["tsla","zz"],"depth_score":99}',), ('Sure: {"sentiment":"bearish"} ok',), ("{broken",), (None,)]
    df = spark.createDataFrame(rows, "content string").withColumn("allowed_tickers", F.array(F.lit("TSLA")))
    got = classify.normalised_answer(df).collect()
    assert (got[0].sentiment, got[0].confidence, got[0].tickers, got[0].depth_score) == ("bullish", 1.0, ["TSLA"], 10)
    assert got[1].sentiment == "bearish" and got[2].sentiment == "irrelevant" and got[3].evidence_quality == "low"


def test_pairs_upgrade_unknown(spark):
    df = spark.createDataFrame([(["a", "b", "A", " "], ["", "Bee", "Aye"])], "t array<string>, c array<string>")
    got = df.select(mentions.pairs(F.col("t"), F.col("c"))).first()[0]
    assert [(r.ticker, r.company_name) for r in got] == [("A", "Aye"), ("B", "Bee")]


def test_usual_company_breaks_ties_by_name(spark):
    df = spark.createDataFrame([("T", "b"), ("T", "a"), ("T", "Unknown"), ("T", "Unknown"), ("U", "Unknown")], "ticker string, company_name string")
    got = {r.ticker: r.company_name for r in corpus.with_usual_company(df).collect()}
    assert got == {"T": "a", "U": "Unknown"}


def test_asof_takes_the_first_bar_on_or_after(spark):
    bars = spark.createDataFrame([("T", day(2), 1.0), ("T", day(5), 2.0), ("T", day(9), 3.0)], "ticker string, date date, close double")
    events = spark.createDataFrame([(i, "T", day(i)) for i in range(1, 12)] + [(99, "Z", day(3))], "id long, ticker string, d date")
    got = {r.id: r.close for r in prices.asof_forward(events, bars, "d", ["close"]).collect()}
    want = {i: 1.0 if i <= 2 else 2.0 if i <= 5 else 3.0 if i <= 9 else None for i in range(1, 12)} | {99: None}
    assert got == want


def test_outcomes_of_short_series(spark):
    rows = [("T", day(i + 1), 1.0, float(c), 10.0) for i, c in enumerate((2, 4, 0, 3))]
    out = prices.with_outcomes(spark.createDataFrame(rows, "ticker string, date date, open double, close double, volume double")).orderBy("date").collect()
    assert out[0].raw_return_1d == 1.0 and out[0].raw_return_5d is None and out[2].raw_return_1d is None and out[0].volatility_1d is None
    assert out[0].drawdown_3d == -1.0 and out[0].baseline_volume is None and out[3].prior_return_5d == 0.5


def test_placeholders_never_replace_bars(spark):
    bars = spark.createDataFrame([("T", day(1), 5.0, True)], "ticker string, date date, close double, price_available boolean")
    wanted = spark.createDataFrame([("T", day(1)), ("T", day(2)), ("T", day(2))], "ticker string, date date")
    got = sorted((r.date, r.close, r.price_available) for r in prices.with_placeholders(bars, wanted).collect())
    assert got == [(day(1), 5.0, True), (day(2), None, False)]


def events_frame(spark):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [("T", "s1", at(0), 10.0), ("T", "s2", at(5), 21.0), ("T", "s3", at(6), 22.0), ("T", "s4", at(20), 33.9), ("T", "s5", at(31), 5.0), ("U", "s6", at(1), 0.0)]
    return spark.createDataFrame(rows, "ticker string, signal_id string, signal_time timestamp, strength double")


def test_cooldown_depends_on_what_was_accepted(spark):
    got = sorted(r.signal_id for r in cooldown.cooldown(events_frame(spark)).collect())
    assert got == ["s1", "s3", "s5", "s6"]  # s2 is 11 stronger only, s3 12; s4 is within a day of s3, s5 is not


def streamed(frames, flow, name, tmp_path):
    """The rows that a flow gives for frames that come one after another."""
    for i, f in enumerate(frames):
        f.coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    spark = frames[0].sparkSession
    source = tmp_path / "in"
    source.mkdir()
    out = []
    for i, f in enumerate(frames):
        for j, part in enumerate(sorted((tmp_path / f"in{i}").glob("*.parquet"))):
            (source / f"{i:03d}-{j}.parquet").write_bytes(part.read_bytes())
        stream = flow(spark.readStream.schema(f.schema).parquet(str(source)))
        q = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        q = q.option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).start()
        q.awaitTermination(120)
    return [r for r in spark.read.parquet(str(tmp_path / "out")).collect()]


def test_cooldown_stream_equals_batch(spark, tmp_path):
    got = streamed([events_frame(spark)], lambda e: flows.cooldown(e, late=None), "cool", tmp_path)
    assert sorted(r.signal_id for r in got) == ["s1", "s3", "s5", "s6"]


def test_cooldown_stream_waits_for_late_events(spark, tmp_path):
    """Events come in any order within the watermark; what is decided equals the table's decision."""
    events = events_frame(spark)
    end = spark.createDataFrame([("Z", "end", dt.datetime(2024, 3, 1), 0.0)], events.schema)
    frames = [events.filter("signal_id IN ('s3', 's5')"), events.filter("signal_id IN ('s1', 's6', 's4')"), events.filter("signal_id = 's2'"), end]
    got = streamed(frames, lambda e: flows.cooldown(e, late="40 hours"), "late", tmp_path)
    assert sorted(r.signal_id for r in got) == ["s1", "s3", "s5", "s6"]


def test_dedupe_and_sessions_on_a_stream(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    at = [0, 1, 2, 20, 21, 60]
    df = spark.createDataFrame([(f"i{h}", "T", base + dt.timedelta(hours=h)) for h in at] * 2, "item_id string, ticker string, created_time timestamp")
    end = spark.createDataFrame([("end", "Z", base + dt.timedelta(days=60))], df.schema)
    got = streamed([df, df.limit(2), end], flows.deduped, "dedupe", tmp_path)
    assert sorted(r.item_id for r in got) == sorted([f"i{h}" for h in at] + ["end"])
    (tmp_path / "s").mkdir()
    got = streamed([df.dropDuplicates(), end], flows.sessions, "sessions", tmp_path / "s")
    assert sorted((r.start.day, r.total_mentions) for r in got if r.ticker == "T") == [(1, 2), (1, 3), (3, 1)]


def test_weekly_stream_equals_batch(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(f"i{i}", "T" if i % 3 else "U", "bullish" if i % 2 else "bearish", base + dt.timedelta(hours=9 * i)) for i in range(60)]
    df = spark.createDataFrame([*rows, *rows[:5]], "item_id string, ticker string, sentiment string, created_time timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = flows.weekly(flows.deduped(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), late=None)
    q = stream.writeStream.format("memory").queryName("weeks").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    want = {
        (r.ticker, r.w): r.n
        for r in df.dropDuplicates(["item_id"]).groupBy("ticker", mentions.week(F.col("created_time")).alias("w")).agg(F.count(F.lit(1)).alias("n")).collect()
    }
    got = {(r.ticker, r.bucket_start): r.total_mentions for r in spark.table("weeks").collect()}
    assert got and all(want[k] == v for k, v in got.items())


def test_upsert_is_idempotent(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k long, v string, added string")
    new = spark.createDataFrame([(2, "B", "z"), (3, "c", "w")], "k long, v string, added string")
    once = storage.upsert(old, new, ["k"], keep=["added"])
    twice = storage.upsert(once, new, ["k"], keep=["added"])
    assert sorted(map(tuple, once.select("k", "v", "added").collect()), key=str) == sorted(map(tuple, twice.select("k", "v", "added").collect()), key=str)
    assert {r.k: (r.v, r.added) for r in once.collect()}[2] == ("B", "y")
    path = str(tmp_path / "t")
    runs = lambda v: spark.createDataFrame([(v, "r1"), (v + 1, "r2")], "v long, analysis_run_id string")
    storage.replace_run(runs(1), path)
    storage.replace_run(runs(5).filter("analysis_run_id = 'r2'"), path)
    assert {r.analysis_run_id: r.v for r in spark.read.parquet(path).collect()} == {"r1": 1, "r2": 6}
    storage.export(spark.createDataFrame([(1, ["a"])], "k long, l array<string>"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().l == '["a"]'


def test_feed_entries(spark, tmp_path):
    (tmp_path / "f.xml").write_text(
        '<feed xmlns="http://www.w3.org/2005/Atom"><entry><author><name>/u/joe</name></author><content type="html">&lt;p&gt;Hi &amp;amp; bye&lt;/p&gt;</content>'
        '<id>t3_abc</id><link href="https://x/r/Stocks/comments/abc/t/"/><published>2024-01-02T03:04:05+00:00</published><title>T</title></entry>'
        '<entry><author><name></name></author><content type="html">c</content><id>t1_zz</id><link href="https://x/r/Stocks/comments/abc/t/zz/"/>'
        "<updated>2024-01-03T00:00:00+00:00</updated><title>joe on T on x</title></entry></feed>"
    )
    post, comment = feeds.atom_entries(spark, str(tmp_path / "f.xml")).orderBy("item_id", ascending=False).collect()
    assert (post.item_id, post.author, post.body_text, post.subreddit, post.item_type) == ("t3_abc", "joe", "Hi & bye", "stocks", "post")
    assert (comment.comment_id, comment.author, comment.thread_title, comment.thread_id) == ("zz", "[deleted]", "T on x", "abc")


def test_catalog_last_duplicate_wins(spark, tmp_path):
    (tmp_path / "c.csv").write_text("ticker,company_name,aliases\naa,Old,x|y\nAA,New,y| Z \n,none,\nBB,Bee,y\n")
    c = feeds.catalog(spark, str(tmp_path / "c.csv"))
    assert {r.ticker: (r.company_name, r.aliases) for r in c.collect()} == {"AA": ("New", ["y", "z"]), "BB": ("Bee", ["y"])}
    assert [r.alias for r in feeds.duplicate_aliases(c).collect()] == ["y"]


def test_regression_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2))
    y = 1 + x @ [2, -1] + rng.normal(size=200)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    fit = stats.regression(df, "y", ["a", "b"])
    beta = np.linalg.lstsq(np.column_stack((np.ones(200), x)), y, rcond=None)[0]
    assert [t["coefficient"] for t in fit["terms"]] == pytest.approx(beta.tolist())
    assert stats.regression(df.limit(4), "y", ["a", "b"]) is None
    assert abs(stats.with_predictions(df, fit, "y").agg(F.avg("residual")).first()[0]) < 1e-9


def test_correlations_of_constants_and_few_rows(spark):
    rows = [("s", "o", 1.0, float(i)) for i in range(5)] + [("s", "p", float(i), 2.0 * i) for i in range(5)] + [("s", "q", 1.0, None)]
    df = spark.createDataFrame(rows, "signal string, outcome string, x double, y double")
    for grid in (stats.pearson_grid, stats.spearman_grid, stats.kendall_grid):
        got = {r.outcome: r for r in grid(df).collect()}
        assert got["o"].correlation is None and got["p"].correlation == 1.0 and got["p"].p_value is None
        assert got["q"].sample_size == 0 and got["q"].missing_count == 1


def test_descriptive_equals_pandas(spark):
    import pandas as pd

    v = pd.Series(np.random.default_rng(5).gamma(2, size=300))
    r = stats.descriptive(spark.createDataFrame(pd.DataFrame({"v": v})), ["v"]).first()
    assert (r.skewness, r.kurtosis) == (pytest.approx(v.skew(), abs=1e-3), pytest.approx(v.kurt(), abs=1e-3)) and r.sd == pytest.approx(v.std(), abs=1e-4)


def test_presets_are_complete():
    assert set(lex.REVIEW_PRESETS) == {"balanced", "high_signal", "low_hype_leads", "new_tickers", "needs_verification"}
