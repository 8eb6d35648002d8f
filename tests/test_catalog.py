"""Catalog tables in texts, JSON tables, consensus, calendars, rolling ranks, feeds: against brute force."""

import datetime as dt
import json
import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from chatterflow.functions import json as J
from chatterflow.functions import lexicons as lex
from chatterflow.operators import catalog, classify, corpus, stats
from chatterflow.sources import feeds

CATALOG = "line long, ticker string, company_name string, aliases string"


def brute(lines, texts):
    known = {}
    for _, ticker, name, aliases in sorted(lines, key=lambda r: r[0]):
        if (ticker or "").strip():
            known[ticker.strip().upper()] = ((name or "").strip(), aliases or "")
    lookup = {}
    for ticker, (name, aliases) in known.items():
        for a in [name, *aliases.split("|")]:
            if a.strip():
                lookup[a.strip().lower()] = ticker
    out = []
    for text in texts:
        found = [t for t in re.findall(r"\$([A-Z]{1,5})\b", text or "") + re.findall(r"\b([A-Z]{2,5})\b", text or "") if t in known and t not in lex.AMBIGUOUS_SYMBOLS]
        low = (text or "").lower()
        found += [t for a, t in lookup.items() if a in low and re.search(rf"(?<!\w){re.escape(a)}(?!\w)", low)]
        found = list(dict.fromkeys(found))
        out.append((found, [known[t][0] or "Unknown" for t in found]))
    return out


def test_entities_of_odd_names(spark):
    lines = [
        (1, "TSLA", "Tesla", "tesla motors|musk's firm|"), (2, "T", "AT&T", "at & t|&t"), (3, "IT", "Gartner", "it"), (4, " nvda", None, "Nvidia|ray tracing"), (5, "TSLA", "Tesla Inc.", "model 3"), (6, "", "Nobody", "x"),
        (7, "F", "Ford", "model t|Nvidia"), (8, "GE", "", r"a\Eb|c++|(g.e.)|$$|GE Vernova"), (9, "ÖKO", "Ökö Werk", "über"), (None, "LAST", "first of all", ""),
    ]
    lines = lines[:-1]
    texts = [
        "$TSLA and NVDA, GE. IT said model 3", "tesla motors' at&t at & t x&t (g.e.) c++ c+++ a\\eb", "Musk's Firm made Model T; nvidia, nvidias and xnvidia", "über Überall ökö werk $$ $", None, "", "$T $F $ford F T GE", "tesla inc. tesla inc",
        "ray  tracing ray tracing", "model model t", "$$$ ge vernova",
    ]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, body_text string").withColumn("key", F.lit("x"))
    got = {r.item_id: (r.tickers, r.company_names) for r in catalog.entities(items, spark.createDataFrame(lines, CATALOG)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(lines, texts)
    none = catalog.entities(items, spark.createDataFrame([], CATALOG)).collect()
    assert len(none) == len(texts) and all(r.tickers == [] for r in none)


def test_a_hundred_thousand_aliases(spark):
    draw = random.Random(2)
    words = [f"w{i}" for i in range(4000)]
    lines = [(i, f"T{i:05}", f"{draw.choice(words)} {draw.choice(words)}", "|".join(" ".join(draw.choices(words, k=draw.randint(1, 3))) for _ in range(2))) for i in range(40_000)]
    texts = [" ".join(draw.choices(words, k=30)) for _ in range(120)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, body_text string")
    table = spark.createDataFrame(lines, CATALOG)
    assert catalog.lookup(table).filter("kind = 2").count() > 60_000
    got = {r.item_id: (r.tickers, r.company_names) for r in catalog.entities(items, table).collect()}
    want = brute(lines, texts)
    assert [got[i] for i in range(120)] == want and sum(len(t) for t, _ in want) > 500


def shuffled(spark):
    """Bytes that all stages so far have written for shuffles."""
    gate, sc = spark.sparkContext._gateway, spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, gate.new_array(gate.jvm.double, 0), gate.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_entities_shuffle_less_than_their_texts(spark):
    draw = random.Random(4)
    words = [f"word{i}" for i in range(3000)]
    weights = [1 / (i + 5) for i in range(3000)]
    texts = [" ".join(draw.choices(words, weights, k=400)) + f" $T{chr(65 + i % 26)}" for i in range(2000)]
    lines = [(i, f"T{chr(65 + i % 26)}{chr(65 + i // 26)}" if i >= 26 else f"T{chr(65 + i)}", " ".join(draw.choices(words, k=1 + i % 3)), f"{texts[i][:30]} - x") for i in range(600)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, body_text string").repartition(4).localCheckpoint()
    table = spark.createDataFrame(lines, CATALOG).localCheckpoint()
    before = shuffled(spark)
    got = {r.item_id: (r.tickers, r.company_names) for r in catalog.entities(items, table).select("item_id", "tickers", "company_names").collect()}
    moved = shuffled(spark) - before
    assert [got[i] for i in range(0, 2000, 40)] == brute(lines, texts[::40])
    assert moved < 0.75 * sum(map(len, texts))


def test_entities_in_blocks_of_any_size(spark, monkeypatch):
    draw = random.Random(6)
    words = ["a", "b", "cc", "dé", "É", "x_1", "9", "Σ", "日本"]
    seams = [" ", "  ", "-", ". ", " & ", "(", ", "]
    some = lambda n: "".join(draw.choice(words) + draw.choice(seams) for _ in range(n))
    lines = [(i, f"{draw.choice(['T', 'OK', 'Wörd', 'TOOLONG', 'IT'])}{chr(65 + i)}" if i % 5 else "AB", some(draw.randint(1, 2)), "|".join(some(draw.randint(0, 5)).strip() for _ in range(3)) + draw.choice(["", "|$$", "|é"])) for i in range(20)]
    texts = [draw.choice(["", "(", "$AB ", "$TB TC "]) + some(draw.randint(0, 60)) for _ in range(150)] + ["", None, "$$", "é"]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, body_text string")
    want = brute(lines, texts)
    for size, most in ((1 << 24, 4096), (100, 7)):
        for name, value in (("BLOCK", size), ("TEXTS", most), ("PIECE", 64), ("MAX_BITS", 7)):
            monkeypatch.setattr(catalog, name, value)
        got = {r.item_id: (r.tickers, r.company_names) for r in catalog.entities(items, spark.createDataFrame(lines, CATALOG)).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_json_tables_come_back(spark):
    cells = ['{"a":[1,null,"x"],"b":{"c":1.5}}', "[]", "{broken", None, '"text"', "", "NaN", "12", "{} {}", "1,2", "1] x", "1} x", "null"]
    df = spark.createDataFrame([(i, c, float("nan") if i % 2 else 0.5) for i, c in enumerate(cells)], "id long, list_json string, score double")
    out = J.decoded(df, {"list_json": "[]"})
    rows = {r.id: r for r in out.select("id", J.value(F.col("list_json"), "$.b.c", "double").alias("c"), J.encoded(out).alias("row"), F.schema_of_variant("list_json").alias("kind")).collect()}
    assert rows[0].c == 1.5 and rows[1].c is None and rows[2].kind == rows[4].kind == "STRING"
    for i, c in enumerate(cells):
        back = json.loads(rows[i].row)
        try:
            want = json.loads("[]" if c is None else c)
            want = c if isinstance(want, float) and math.isnan(want) else want
        except ValueError:
            want = c
        assert back == {"id": i, "list_json": want, "score": None if i % 2 else 0.5}


def test_signature_follows_every_row(spark):
    row = lambda i, s="bullish": ("T", i, s, 1.5, 2, 1, "model", dt.datetime(2024, 1, 1), [f"c{i}"])
    kind = "ticker string, item_id string, sentiment string, alpha_signal_score double, hype_score int, evidence_quality_numeric int, classifier_mode string, created_time timestamp, claims array<string>"
    sign = lambda *rows: corpus.consensus(spark.createDataFrame(list(rows), kind)).first().signature
    sets = [[row("a")], [row("a")] * 2, [row("a")] * 3, [row("a")] * 4, [row("a"), row("b")], [row("a"), row("b", "bearish")], [row("b")]]
    assert len({sign(*s) for s in sets}) == len(sets)
    assert sign(row("a"), row("b")) == sign(row("b"), row("a")) and len(sign(row("a"))) == 20


def test_calendar_of_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(corpus, "CHUNK", 7)
    rows = [(k, dt.date(2024, 1, 1) + dt.timedelta(days=d), 1) for k in "abc" for d in range(0, 50, ord(k) - 95)]
    got = corpus.dense(spark.createDataFrame(rows, "k string, t date, n long"), "k", "t", ["n"]).collect()
    times = {t for _, t, _ in rows}
    have = {(k, t) for k, t, _ in rows}
    assert {(r.k, r.t): r.n for r in got} == {(k, t): int((k, t) in have) for k in "abc" for t in times} and len(got) == 3 * len(times)
    assert corpus.dense(spark.createDataFrame([], "k string, t date, n long"), "k", "t", ["n"]).collect() == []


def ranks(v):
    return [sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for a in v]


def test_rolling_ranks_cross_blocks(spark, monkeypatch):
    monkeypatch.setattr(stats, "RANKS", 16)
    draw = random.Random(6)
    rows = [(i, "ab"[i % 3 == 0], float(draw.randrange(6)), float(draw.randrange(9)) if i % 7 else None) for i in range(150)]
    df = spark.createDataFrame(rows, "i long, k string, x double, y double")
    for by in ([], ["k"]):
        for method in ("spearman", "kendall"):
            got = {r.i: r for r in stats.rolling_ranks(df, "x", "y", ["i"], method, 10, by).collect()}
            for key in ["a", "b"] if by else [None]:
                full = [r for r in rows if r[3] is not None and key in (None, r[1])]
                for n, r in enumerate(full):
                    w = full[max(0, n - 9) : n + 1]
                    x, y = [v[2] for v in w], [v[3] for v in w]
                    assert got[r[0]].rows_in_window == len(w)
                    if method == "spearman":
                        want = np.corrcoef(ranks(x), ranks(y))[0, 1] if len(set(x)) > 1 and len(set(y)) > 1 else None
                    else:
                        sign = lambda v, a, b: (v[b] > v[a]) - (v[b] < v[a])
                        pairs = [(sign(x, a, b), sign(y, a, b)) for a in range(len(w)) for b in range(a)]
                        bottom = (sum(p != 0 for p, _ in pairs) * sum(q != 0 for _, q in pairs)) ** 0.5
                        want = sum(p * q for p, q in pairs) / bottom if bottom else None
                    have = got[r[0]].rolling_correlation
                    assert have is None if len(w) < 8 or want is None else abs(have - want) < 1e-5
            assert len(got) == sum(r[3] is not None for r in rows)


def test_answers_and_retries(spark):
    items = spark.createDataFrame([(i, "", "revenue up", ["TSLA"], ["Tesla"]) for i in range(7)], "item_id long, thread_title string, body_text string, tickers array<string>, company_names array<string>")
    answers = [
        (0, 0, '{"sentiment":"bearish","tickers":["tsla","x","TSLA"],"needs_deeper_analysis":2,"confidence":null,"red_flags":["a",null," "],"bull_case":"None"}'), (1, 0, "no"), (1, 1, 'x {"hype_score":"4.9"} y'), (1, 2, '{"hype_score":9}'),
        (2, 0, "{"), (3, 0, "[1]"), (4, 0, None), (5, 0, '{"claims_to_verify":"one","claim_specificity_score":-3,"needs_deeper_analysis":"no"}'),
    ]
    got = {r.item_id: r for r in classify.answered(items, spark.createDataFrame(answers, "item_id long, attempt int, content string")).collect()}
    assert [got[i].classifier_mode for i in range(7)] == ["ollama", "ollama", "fallback", "fallback", "fallback", "ollama", "fallback"]
    a, b, c = got[0], got[1], got[5]
    assert (a.sentiment, a.tickers, a.company_names, a.needs_deeper_analysis, a.confidence, a.red_flags, a.bull_case) == ("bearish", ["TSLA"], ["Tesla"], True, 0.0, ["a", "None"], "")
    assert (b.hype_score, b.confidence, b.sentiment) == (4, 0.3, "irrelevant")
    assert c.claims_to_verify == ["one"] and c.claim_specificity_score > 0 and c.needs_deeper_analysis is False
    assert got[6].claims_to_verify == ["Verify the revenue claim against recent company filings."]


def test_feeds_stop_at_the_first_older_post(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    rows = [("a", "s", 0, day(9)), ("b", "s", 1, day(30)), ("c", "s", 2, day(1)), ("d", "s", 3, day(8)), ("e", "t", 5, day(8))]
    kind = "item_id string, source_name string, feed_position int, created_time timestamp"
    items = spark.createDataFrame(rows, kind).withColumns({"item_type": F.lit("post"), "source_type": F.lit("subreddit"), "thread_id": F.col("item_id")})
    assert sorted(r.item_id for r in feeds.collect(items, "2024-01-05", "2024-01-20").collect()) == ["a", "e"]
    assert sorted(r.item_id for r in feeds.collect(items.drop("feed_position"), "2024-01-05", "2024-01-20").collect()) == ["a", "d", "e"]
