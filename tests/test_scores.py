"""Hand-computed expectations of the score formulas."""

import hashlib

import pytest
from pyspark.sql import functions as F

from chatterflow.functions import scores as S
from chatterflow.functions import text as T

L = F.lit

def cases():
    return [
        (S.growth(L(3), L(2)), 0.5), (S.growth(L(3), L(0)), None),
        (S.controversy(L(3), L(1)), 5.0), (S.controversy(L(0), L(0)), 0.0), (S.diversity(L(2), L(1)), 6.5),
        (S.popularity_penalty(L("NVDA"), L(14)), 11.6), (S.popularity_penalty(L("XYZ"), L(14)), 1.6), (S.popularity_penalty(L("XYZ"), L(60)), 25.0),
        (S.acceleration(L(2), L(0), L(None).cast("double"), L(2), L(1), L(0.0), L(0.0), L(True)), 57.0),
        (S.acceleration(L(4), L(2), L(1.0), L(1), L(0), L(6.0), L(1.0), L(False)), 38.8),
        (S.hype_adjusted(L(60.0), L(4), L(2)), 39.0),
        (S.bounded_growth(L(1.0), L(0.0)), 4.0), (S.bounded_growth(L(0.0), L(0.0)), 0.0), (S.bounded_growth(L(0.0), L(5.0)), -1.0), (S.bounded_growth(L(9.0), L(1.0)), 4.0),
        (S.coverage_reliability(L("subreddit"), L(True), L(False), L(False), L(False), L(29), L(0.0)), 0.78),
        (S.bull_bear(L(2), L(0)), 5.0), (S.attention_spread(L(4), L(2), L(3), L(1), L(10.0)), 45.0),
        (S.sample_reliability(L(19)), "Unreliable"), (S.sample_reliability(L(20)), "Weak evidence"), (S.sample_reliability(L(50)), "Moderate evidence"), (S.sample_reliability(L(100)), "Stronger evidence"),
        (S.repetition(L("moon moon moon BUY now HUGE obviously")), 6), (S.specificity(L("revenue of 5 at www.x")), 4), (S.specificity(L(None).cast("string")), 0),
        (T.author_hash(L("")), hashlib.sha1(b"[deleted]").hexdigest()[:12]), (T.excerpt(L("a  b\n c")), "a b c"), (T.community(L("https://x/r/Stocks/comments/abc/t")), "stocks"), (T.thread_id(L("https://x/r/Stocks/comments/abc/t")), "abc"),
        (T.source_kind(L("r/stocks")), "subreddit"), (T.source_kind(L("https://x/r/s/comments/abc/t")), "thread_url"), (T.source_kind(L("!")), "invalid"), (T.author(L("/u/joe")), "joe"), (T.author(L(" ")), "[deleted]"),
        (T.html_to_text(L("<p>a</p><!-- x --><b>b</b>&amp;c &lt;d")), "a b &c <d"), (T.market_symbol(L("SQ")), "XYZ"), (T.slug(L("A b--C!")), "a-b-c"),
    ]


def test_formulas(spark):
    want = cases()
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(want)]).first()
    for i, (_, x) in enumerate(want):
        assert row[i] == (pytest.approx(x) if isinstance(x, float) else x), (i, row[i], x)


def test_symbols_keep_order_and_skip_ambiguous(spark):
    df = spark.createDataFrame([("Buy $TSLA and NVDA, IT TSLA ÉNVDA",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(T.symbols(F.col("t"), ("TSLA", "NVDA", "IT"))).collect()]
    assert got[0] == ["TSLA", "NVDA"] and not got[1] and not got[2]
    found = df.select(T.aliases(F.col("t"), {"buy": "B", "vda": "V"})).first()[0]
    assert found == ["B"]


def test_scores_stay_in_bounds(spark):
    df = spark.range(2000).selectExpr("rand(1) * 400 - 100 AS a", "rand(2) * 20 - 5 AS b", "cast(rand(3) * 90 AS long) AS n")
    a, b, n = F.col("a"), F.col("b"), F.col("n")
    out = df.select(
        S.hype_adjusted(a, b, b).alias("h"), S.acceleration(n, n, b, n, n, b, b, n % 2 == 0).alias("x"),
        S.emerging(a, b, a, b, b, b, b, b, n > 5, n > 7, n, n, n).alias("e"),
    ).agg(*(f(c) for c in "hxe" for f in (F.min, F.max))).first()
    assert all(0 <= v <= 100 for v in out)


def test_entities_equal_the_library(spark):
    import html

    from chatterflow.functions import text as T

    texts = ["a &amp;lt; b", "&lt;&gt;&quot;&#39;&#x27;&apos;", "&#8364; &#x1F642; &euro; &hellip; &nosuch; &eacute;", "&amp;#65; &#65; &amp;amp;", "&#0; &#55555; &#150; &#9999999;", "no entity", "&", "&&amp;&", "&NotEqualTilde; &ngE;", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.u for r in df.select("i", T.unescape(F.col("t")).alias("u")).collect()}
    assert got == {i: None if t is None else html.unescape(t) for i, t in enumerate(texts)}
