import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatterflow.llm import mixing, packing, queries, url_filter

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def file():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def check_packed(rows, capacity=2048):
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0) and 0 < r.length <= capacity
        ends[r.sequence_id] = r.offset + r.length
    assert not ends or max(ends.values()) <= capacity
    return len(ends)


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_pieces_equal_the_library(spark, docs, file):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(file)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(200).collect()]
    texts += ["", None, "don't x'D it's I'LL", "ÉCOLE naïve_x 12³ ªº é, É!!", "ΑΣ Σ İx", "é x́", "<|endoftext|> a<|startoftext|>b <|x|>", "a\x1cb \x85 c\xa0d", "日本語 !!ab", "ǅ ŉ ß ẞ", "tab\tx\x0by\x7f", "..., \\ x\\", " "]
    for capacity in (2048, 100):
        got = {}
        for r in packing.pack(docs(texts), file, capacity).collect():
            got.setdefault(r.doc_id, []).append(r)
        for i, t in enumerate(texts):
            ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
            want = [(j // capacity, j, len(ids[j : j + capacity]), zlib.crc32(ids[j : j + capacity].tobytes())) for j in range(0, len(ids), capacity)]
            assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got[i]) == want, t
        check_packed([r for x in got.values() for r in x], capacity)


@pytest.mark.parametrize("bits", [22, 8])
def test_ids_of_random_strings_equal_the_library(file, bits):
    """With tables too small for a chunk as well, which start anew or serve one text only."""
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    from chatterflow.llm.common import text_bytes

    lib, by_table, draw = Tokenizer.from_file(file), packing.WordIds(file, bits), random.Random(9)
    parts = [*"abcXYZ019 '.,<>|!\t\n\x00\x1c\x7f", "é", "É", "ß", "×", "÷", "ÿ", "À", "İ", "œ", "Ω", "日", "e\u0301", "\xa0", "\x85", "ª", "²", "<|endoftext|>", "'s", "'LL", "don't", "🙂", "word", "Straße" * 4]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(14))) for _ in range(10_000)]
    for i in range(0, len(texts), 500):
        ids, at = by_table.ids(*text_bytes(pa.array(texts[i : i + 500])))
        for j, t in enumerate(texts[i : i + 500]):
            assert ids[at[j] : at[j + 1]].tolist() == [*lib.encode(t, add_special_tokens=False).ids, 0], t


def test_packing_is_best_fit_decreasing(spark, file):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    a = packing.pack(df, file).collect()
    assert check_packed(a) == best_fit_decreasing([r.length for r in a], 2048)
    b = packing.pack(df, file, broadcast_runs=0).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


@pytest.mark.parametrize("seed", range(6))
def test_rounds_decide_as_best_fit(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(rng.geometric(0.02 * (seed + 1), 3000), 100)
    values, n = np.unique(lengths, return_counts=True)
    counts = dict(zip(values.tolist(), n.tolist(), strict=True))
    runs = packing.rounds(counts, 100)
    fill, place = {}, {}
    for i, (length, first, sequence, each, offset) in enumerate(runs.tolist()):
        last = runs[i + 1][1] if i + 1 < len(runs) and runs[i + 1][0] == length else counts[length]
        for rank in range(first, last):
            s, o = sequence + (rank - first) // each, offset + (rank - first) % each * length
            place.setdefault(s, []).append((o, length))
            fill[s] = fill.get(s, 0) + length
    for parts in place.values():
        at = 0
        for o, length in sorted(parts):
            assert o == at
            at += length
    assert max(fill.values()) <= 100 and len(fill) == best_fit_decreasing(lengths.tolist(), 100) and sum(fill.values()) == lengths.sum()


@pytest.mark.parametrize("seed", range(8))
def test_runs_are_bounded_by_the_capacity(seed):
    """Whatever the counts: many of each length, few of each, or mixed magnitudes."""
    rng = np.random.default_rng(seed)
    for capacity in (64, 500, 2048):
        lengths = rng.permutation(np.arange(1, capacity + 1))[: rng.integers(1, capacity + 1)]
        counts = {int(x): int(n) for x, n in zip(lengths, (10 ** rng.uniform(0, 9, len(lengths))).astype(np.int64), strict=True)}
        assert len(packing.rounds(counts, capacity)) <= packing.most_runs(capacity)
    assert packing.most_runs(8192) <= packing.BROADCAST_RUNS


def test_packing_odd_rows(odd, docs, file):
    rows = packing.pack(odd, file).collect()
    check_packed(rows)
    assert len({r.doc_id for r in rows}) == 7 and packing.pack(docs([]), file).collect() == []


def source_docs(docs):
    texts = []
    for s, n in (("big", 400), ("mid", 120), ("low", 40), (None, 20)):
        texts += [("w " * (1 + i % 9), "en", s) for i in range(n)]
    return docs(texts)


def test_mixing_meets_its_targets(docs):
    df = source_docs(docs)
    table = mixing.measured(df)
    total = table.agg(F.sum("n_tokens")).first()[0]
    for target, limit in ((0.95, 50.0), (0.99, 2.0)):
        plan = {r.source: r for r in mixing.plan(table, 1.0, target, limit).collect()}
        w = [r.weight for r in plan.values()]
        entropy = -sum(x * math.log(x) for x in w) / math.log(len(w))
        assert sum(w) == pytest.approx(1)
        passes = max(r.weight * total / r.n_tokens for r in plan.values())
        assert entropy == pytest.approx(target, abs=1e-6) if limit == 50 else passes == pytest.approx(limit, abs=1e-6)
        shares = {s: (r.n_tokens / total) ** plan["big"].exponent for s, r in plan.items()}
        assert {s: r.weight for s, r in plan.items()} == pytest.approx({s: x / sum(shares.values()) for s, x in shares.items()})
        rows = mixing.draws(table, mixing.plan(table, 1.0, target, limit)).collect()
        longest = 9
        by = {}
        for r in rows:
            by.setdefault(r.source, []).append(r)
        for s, p in plan.items():
            drawn = sum(r.n_tokens for r in by[s])
            assert p.target_tokens - longest < drawn <= p.target_tokens
            full = p.target_tokens // p.n_tokens
            times = {}
            for r in by[s]:
                times[r.doc_id] = times.get(r.doc_id, 0) + 1
            assert all(full <= n <= full + 1 for n in times.values()) and (not full or len(times) == p.n_docs)
            for k in range(full + 1):  # blocks come whole, but for the last of the last pass
                of = {}
                for r in by[s]:
                    if r["pass"] == k:
                        of.setdefault((r.block_rank, r.block), 0)
                assert len({b for _, b in of}) == len(of) == len({a for a, _ in of})


def test_mixing_natural_weights_and_odd_rows(docs, odd):
    even = docs([("a b c", "en", s) for s in "xyz" * 10])
    assert sorted(r.doc_id for r in mixing.mix_sources(even).collect()) == list(range(30))
    assert mixing.mixed(odd).columns == odd.columns and set(r.source for r in mixing.mixed(odd).select("source").collect()) <= {None, "s", "t"}
    assert mixing.mix_sources(docs([])).collect() == [] and mixing.mixed(docs([])).collect() == []
    assert mixing.mix_sources(docs([None, ""])).count() == 0
    plan = mixing.mixed(even)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_words_as_tokens(spark):
    texts = ["", " ", "a", " a", "a ", "a  b\n", "\x0ba\x0c b\xa0c", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(mixing.n_words(F.col("t"))).collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


URLS = [
    ("http://A.Example.NET/en/x?q", "allow", "example.net/en/"), ("http://a.example.net/fr/", "block", "net/"), ("https://net/", "block", "net/"), ("https://xnet/", "allow", None), ("http://m.org/fr/1", "allow", "org/fr/"),
    ("http://shop.example.com/de/1#x", "block", "example.com/de/"), ("http://m.casino-win.example.com/en/1", "block", None), ("http://casino-win.example.com", "block", None), ("http://user@free-bets.example.com:80/a", "block", None),
    ("http://xfree-bets.example.com/", "allow", None), ("free-bets.example.com/", "allow", None), (None, "allow", None), ("", "allow", None), ("://", "allow", None), ("http://example.net", "allow", None),
]


def test_urls(spark):
    rows = [(i, u, "h") for i, (u, *_) in enumerate(URLS)]
    got = url_filter.judge(spark.createDataFrame(rows + rows[:3], "page_id long, url string, row string")).collect()
    assert len(got) == len(rows) + 3
    for r in got:
        assert (r.verdict, r.rule) == URLS[r.page_id][1:], URLS[r.page_id]
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_listed_urls_equal_an_exact_join(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 300}.d{i % 7}.example.com/p{i % 11}/q/{i}") for i in range(3000)], "page_id long, url string")
    listed = spark.createDataFrame([(f"h{i}.d{i % 7}.example.com/",) for i in range(0, 300, 5)] + [("d3.example.com/p4/",), ("h1.d1.example.com/p1/q/1",)], "key string")
    want = {i for i in range(3000) if any(f"h{i % 300}.d{i % 7}.example.com/p{i % 11}/q/{i}".startswith(k) for k in [r.key for r in listed.collect()]) or (i % 7 == 3 and i % 11 == 4)}
    got = {r.page_id for r in url_filter.judge(pages, listed, rules=()).filter("listed").collect()}
    assert got == want
    full = np.full((1, 8), 0xFFFFFFFFFFFFFFFF, np.uint64)  # a filter that passes everything changes nothing
    original = url_filter.bloom
    url_filter.bloom = lambda _: full
    try:
        assert {r.page_id for r in url_filter.judge(pages, listed, rules=()).filter("listed").collect()} == want
    finally:
        url_filter.bloom = original


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, want = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    order = lambda columns, rows: sorted(tuple(str(r[columns.index(c)]) for c in sorted(columns)) for r in rows)
    assert order(df.columns, [tuple(r) for r in df.collect()]) == order(want.columns, want.fetchall())
