"""Values beyond any fixed bound: deep folders, long hosts, long tokens, long lists, many languages, rows without ids."""

import random

from pyspark.sql import functions as F

from chatterflow.llm import language_id, secrets, toxicity, url_filter
from chatterflow.llm.common import drawn


def test_deep_folders_and_long_hosts_are_listed(spark):
    deep, long_host = "example.com/a/b/c/d/e/f/g/", "k.j.i.h.g.f.e.d.c.b.org/"
    listed = spark.createDataFrame([(deep,), (long_host,)], "key string")
    urls = [f"http://{deep}x/y/z", f"http://www.{deep}", "http://example.com/a/b/c/d/e/f/x/y", f"http://www.{long_host}p", "http://j.i.h.g.f.e.d.c.b.org/p"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert {r.page_id for r in url_filter.judge(pages, listed, rules=()).filter("listed").collect()} == {0, 1, 3}
    assert url_filter.judge(pages, listed.limit(0), rules=()).filter("listed").collect() == []


def test_long_tokens_in_urls_have_spans():
    text = "see https://" + "u" * 300 + ":" + "p" * 900 + "@host/x"
    assert [(a, b) for a, _, kind, b in secrets.find(text) if kind == "url_auth"] == [(4, text.index("@") + 1)]


def test_lists_in_any_form(spark):
    listed = spark.createDataFrame([("org/",), ("bad.example.com",), ("Up.test:80/",), ("foo.test/p",), ("HTTPS://me@q.test./a/../%62/",), (None,), ("/x",), ("",)], "key string")
    yes = ["http://a.org/", "http://org", "http://bad.example.com", "http://www.bad.example.com/x", "http://www.up.test/z", "http://foo.test/p", "http://foo.test/p/q", "http://w.foo.test/p/", "http://q.test/b/1"]
    no = ["http://example.com/", "http://foo.test/", "http://foo.test/pq", "http://orgx.test/", "http://q.test/a/", "http://q.test/b", "x", None, "http:///x"]
    pages = spark.createDataFrame(list(enumerate(yes + no)), "page_id long, url string")
    got = url_filter.judge(pages, listed, rules=()).collect()
    assert {r.page_id for r in got if r.listed} == set(range(len(yes))) and len(got) == len(yes + no)
    assert all(r.verdict == ("block" if r.listed else "allow") for r in got)


def test_a_long_list_loses_and_adds_nothing(spark, monkeypatch):
    draw = random.Random(8)
    name = lambda: f"h{draw.randrange(30_000)}.s{draw.randrange(40)}.test"
    listed = {f"{name()}/" if draw.random() < 0.5 else f"{name()}/d{draw.randrange(9)}/" for _ in range(120_000)}
    assert len(listed) > 100_000
    monkeypatch.setattr(url_filter, "BITS_PER_KEY", 4)  # a filter that is wrong now and then
    urls = [f"http://{'w.' * draw.randrange(2)}{name()}/d{draw.randrange(12)}/x" for _ in range(20_000)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    keys = spark.createDataFrame([(k,) for k in listed], "key string")

    def covered(url):
        host, folder = url[7:].removeprefix("w.").split("/")[:2]
        return f"{host}/" in listed or f"{host}/{folder}/" in listed

    want = {i for i, u in enumerate(urls) if covered(u)}
    got = url_filter.judge(pages, keys, rules=()).filter("listed").collect()
    assert {r.page_id for r in got} == want and len(got) == len(want) > 1000
    table = url_filter.canonical_list(keys)
    looked_up = pages.select("page_id", url_filter.host("url").alias("host"), url_filter.path("url").alias("path"))
    looked_up = looked_up.withColumn("keys", url_filter.keys(F.col("host"), F.col("path"), *url_filter.depths(table)))
    passed = url_filter.possible_hits(looked_up.withColumn("hashes", F.transform("keys", lambda k: F.xxhash64(k))), url_filter.bloom(table))
    wrong = passed.join(table, "key", "left_anti").count()
    assert 0 < wrong < 0.3 * looked_up.select(F.explode("keys")).count()  # the join has false positives to remove


def test_languages_beyond_a_thousand(spark):
    names = [f"l{i:04}" for i in range(1100)]
    word = lambda i: "".join(chr(97 + (i // 26**k) % 26) for k in range(3)) * 3
    rows = [(i, f"{word(i % 1100)} {word(i % 1100)}", names[i % 1100]) for i in range(3300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(docs)
    got = language_id.predict(docs.limit(200), model).collect()
    assert len(model.langs) > 1024 and sum(r.lang_pred == rows[r.doc_id][2] for r in got) > 190


def test_samples_and_folds_without_ids(spark):
    texts = ["the cat sat on the mat", "der hund und die katze"]
    docs = spark.createDataFrame([(None, f"{texts[i % 2]} {i}", ("en", "de")[i % 2]) for i in range(3000)], "doc_id long, text string, lang string")
    n = docs.filter(drawn(200_000, 1_000_000)).count()
    assert 450 < n < 750
    model = language_id.learn(docs, train_rows=100)
    got = language_id.predict(docs, model).collect()
    assert all(r.held_out is False for r in got) and {r.lang_pred for r in got} == {"en", "de"}


def test_toxicity_labels_and_phrases(spark):
    draw = random.Random(5)
    plain = [f"w{i}" for i in range(60)]
    say = lambda *more: " ".join(draw.sample([*draw.choices(plain, k=20), *more], 20 + len(more)))
    rows = [(i, f"{say('scumbag')} grubworm" if i % 3 == 0 else f"{say()} grubworm soup {say()}" if i % 3 == 1 else say(), i % 3 == 0) for i in range(1500)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(None, "scumbag")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows] + [(None, True)], "doc_id long, toxic boolean")
    lexicon = toxicity.learn(docs, labels)
    assert " scumbag " in lexicon.weights
    assert lexicon.total(toxicity.fold("you scumbag")) > 0
    assert lexicon.total(toxicity.fold("a grubworm soup please")) == 0
    got = toxicity.score(docs, lexicon).collect()
    assert all(r.held_out in (True, False) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == rows[r.doc_id][2] for r in held) > 0.97 * len(held)
    # a term that is harmless in one phrase only
    phrases = toxicity.Lexicon({" grubworm ": 2.0}).pairs(toxicity.fold("hot grubworm soup, grubworm"))
    assert phrases == {"hot grubworm", "grubworm soup"}
