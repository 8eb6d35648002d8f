"""Operators that SQL can't express, against plain loops over the same rules."""

import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chatterflow.llm import language_id, mixing, near_dedup, quality, secrets, toxicity, url_filter
from chatterflow.llm.common import written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
M64 = (1 << 64) - 1


def loop_counts(model, raw):
    """Corrected popcounts of one padded text by Python integers and sets of cells."""
    grams = [int.from_bytes(raw[i : i + 4], "little") for i in range(len(raw) - 3)]
    found = []
    for i in range(len(model.langs)):
        on = set(np.flatnonzero(model.bit(model.tables, i)).tolist())
        rate = (len(on) / (1 << language_id.BITS)) ** language_id.K
        n = sum(all(((g * m & M64) >> (64 - language_id.BITS)) in on for m in language_id._ODD[: language_id.K]) for g in grams)
        found.append(max(0.0, (n - len(grams) * rate) / (1 - rate)))
    return found


@pytest.mark.parametrize("n_langs", [3, 70])
def test_language_equals_set_based_popcounts(docs, n_langs):
    draw = random.Random(n_langs)
    stems = {f"l{i}": ["".join(draw.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(5)) for _ in range(6)] for i in range(n_langs)}
    rows = [(" ".join(draw.choice(stems[lang]) for _ in range(12)), lang, "s") for lang in stems for _ in range(8)]
    # the last two texts are ties: of no language, and of two alike
    texts = [*rows[:60], ("qqqq zzzz", None, "s"), (" ".join((*stems["l0"], *stems["l1"])), None, "s")]
    model = language_id.learn(docs(rows))
    assert len(model.langs) == n_langs
    raw, off, _ = language_id.padded(pa.array([t for t, *_ in texts]))
    got = language_id.predict(docs(texts), model).orderBy("doc_id").collect()
    for i, r in enumerate(got):
        want = loop_counts(model, raw[off[i] : off[i + 1]].tobytes())
        assert r.lang_pred == model.langs[int(np.argmax(want))]
        assert r.n_found == pytest.approx(max(want)) and r.score == pytest.approx(max(want) / sum(want) if sum(want) else 0)


def test_toxicity_equals_a_naive_search():
    draw = random.Random(3)
    parts = ["idiot", "idiotic", "1d10t", "trash", "can", "bag", "clown", "fish", "sore", "loser", "x", "pond", "scum", "CLOWN!"]
    lexicon = toxicity.Lexicon({" idiot ": 4.0, " idio": 2.0, " trash ": 1.0, " clown ": 1.5, " loser ": 1.0, " scum ": 0.5})
    for _ in range(300):
        text = toxicity.fold(" ".join(draw.choice(parts) for _ in range(draw.randrange(12))))
        harmless = [(m.start(), m.end() - 1) for e in lexicon.exceptions for m in re.finditer(f"(?= {e} )", text) for m in [re.compile(f" {e} ").match(text, m.start())]]
        want = 0.0
        for at in range(len(text)):
            fits = [w for term, w in lexicon.weights.items() if text.startswith(term, at)]
            if fits and not any(a <= at < b for a, b in harmless):
                want += max(fits)
        assert lexicon.total(text) == pytest.approx(want), text


def test_labels_of_any_value(spark, docs):
    df = docs([f"good day {i}" if i % 2 else f"you idiot moron {i}" for i in range(400)])
    labels = df.select("doc_id", F.when(F.col("doc_id") % 2 == 0, 2).when(F.col("doc_id") % 5 == 0, -1).otherwise(0).alias("toxic"))
    got = toxicity.score(df, toxicity.learn(df, labels)).collect()
    assert all(r.predicted == (r.doc_id % 2 == 0) for r in got)


def loop_draws(spark, table, plan, seed=17, passes=4):
    """Each draw of a document as (doc_id, pass, block, block_rank), and each document's source."""
    sources = {r.source: r for r in plan.collect()}
    blocks, texts = defaultdict(list), {}
    for r in table.join(plan.select("source", "n_blocks"), "source").select("*", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("n_blocks")).alias("b")).collect():
        blocks[r.source, r.b].append((r.doc_id, r.n_tokens))
        texts[r.doc_id] = r.source
    points = spark.createDataFrame([(s, p, b) for s, b in blocks for p in range(passes)], "source string, pass long, block long")
    order = {(r.source, r["pass"], r.block): r.h for r in points.select("*", F.xxhash64(F.lit(seed), "source", "pass", "block").alias("h")).collect()}
    of_doc = {(r["pass"], r.doc_id): r.h for r in table.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(passes - 1).cast("long"))).alias("pass")).select("*", F.xxhash64(F.lit(seed), "pass", "doc_id").alias("h")).collect()}
    want = Counter()
    for s, p in sources.items():
        if not p.n_tokens:
            continue
        full = p.target_tokens // p.n_tokens
        for turn in range(full + 1):
            left = p.n_tokens if turn < full else p.target_tokens - full * p.n_tokens
            for rank, (_, b) in enumerate(sorted((order[s, turn, b], b) for s2, b in blocks if s2 == s), 1):
                size = sum(n for _, n in blocks[s, b])
                if left <= 0:
                    break
                if size <= left:
                    want.update((d, turn, b, rank) for d, _ in blocks[s, b])
                    left -= size
                    continue
                for _, d, n in sorted((of_doc[turn, d], d, n) for d, n in blocks[s, b]):
                    left -= n
                    if left < 0:
                        break
                    want[d, turn, b, rank] += 1
                break
    return want, texts


def test_draws_equal_a_loop(spark, docs):
    draw = random.Random(4)
    df = docs([("w " * draw.randrange(9), "en", s) for s, n in (("a", 150), ("b", 40), ("c", 9), (None, 5)) for _ in range(n)])
    table = mixing.measured(df)
    plan = mixing.plan(table, 1.3, 0.99, 3.0)
    want, texts = loop_draws(spark, table, plan)
    got = mixing.draws(table, plan).collect()
    assert Counter((r.doc_id, r["pass"], r.block, r.block_rank) for r in got) == want and all(texts[r.doc_id] == r.source for r in got)


def line_chars(text):
    seen, chars = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            chars += sum(map(len, WORD.findall(line))) if line in seen else 0
            seen.add(line)
    return chars


def test_quality_verdicts_equal_a_loop(docs):
    draw = random.Random(5)
    lines = [" ".join(f"w{draw.randrange(400)}" for _ in range(draw.randrange(1, 12))) for _ in range(300)]
    texts = ["\n".join(draw.choice(lines[: draw.choice((20, 300))]) for _ in range(draw.randrange(5, 40))) for _ in range(150)]
    kept = 0
    for r in quality.quality_rules(docs(texts)).collect():
        t = texts[r.doc_id]
        words = WORD.findall(t)
        total, over = sum(map(len, words)), line_chars(t) > quality.LINE_LIMIT * sum(map(len, words))
        for n, limit in quality.LIMITS.items():
            c = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
            inside = {j for i in range(len(words) - n + 1) if c[tuple(words[i : i + n])] > 1 for j in range(i, i + n)}
            over |= sum(len(words[j]) for j in inside) > limit * total
        assert r.dup_line_chars == line_chars(t) and r.kept == (not r.base_failed and not over)
        kept += r.kept
    assert 10 < kept < 140


def test_canonical_paths(spark):
    cases = {"/a/%62/../c": "/a/c", "//a///b/": "/a/b/", "/a/./b/.": "/a/b/", "/..": "/", "": "", "/a%2fb+%zz": "/a%2fb+%zz", "/a%2Fb+%41": "/a%2Fb+A", "/a/..": "/", "/x.y/..z": "/x.y/..z"}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.c for r in df.select("p", url_filter.canonical_path(F.col("p")).alias("c")).collect()} == cases
    listed = spark.createDataFrame([("ex.example.com/bad/",)], "key string")
    urls = ["http://ex.example.com/%62ad/1", "http://EX.example.com:80/x/../bad/2", "http://ex.example.com/bad", "http://ex.example.com//bad//y", "http://ex.example.com/" + "a/" * 20_000, "http://ex.example.com/bad/" + "a" * 100_000]
    pages = spark.createDataFrame([*enumerate(urls), (None, urls[0]), (0, urls[0])], "page_id long, url string")
    got = url_filter.judge(pages, listed, rules=()).collect()
    assert Counter(r.page_id for r in got if r.listed) == {0: 2, 1: 1, 3: 1, 5: 1, None: 1} and len(got) == 8


def test_secret_patterns_are_linear():
    for text in ("eyJ" * 400_000, "eyJa.eyJ" * 150_000, "a://b:" * 200_000, "-----BEGIN " * 100_000, "token " + " " * 1_000_000, "ghp_" * 300_000, "xoxb-" * 200_000, "AKIA" * 300_000):
        began = time.perf_counter()
        secrets.find(text)
        assert time.perf_counter() - began < 1.5, text[:12]


def family(draw, n, words):
    """Copies of one text, edited at up to a fifth of their words."""
    base = [draw.choice(words) for _ in range(150)]
    out = []
    for _ in range(n):
        copy = base[:]
        for _ in range(draw.randrange(12)):
            copy[draw.randrange(150)] = f"e{draw.random()}"
        out.append(" ".join(copy))
    return out


def test_pairs_stay_in_proportion_to_documents(spark, docs, monkeypatch):
    """2,000 texts around one passage, and a family of 2,000 copies from near to far: pairs follow the documents, not their squares."""
    draw = random.Random(6)
    words = [f"w{i}" for i in range(5000)]
    passage = " ".join(draw.choice(words) for _ in range(60))
    texts = [f"{' '.join(draw.choice(words) for _ in range(90))} {passage}" for _ in range(2000)] + family(draw, 2000, words)
    asked, real = [], near_dedup._screened

    def counted(pairs, known, percent):
        asked.append(pairs.count())
        return real(pairs, known, percent)

    monkeypatch.setattr(near_dedup, "_screened", counted)
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(docs(texts)).collect()}
    assert sum(asked) < 30 * len(texts), asked
    assert all(got[i] == i for i in range(2000))
    # every link of the family, by an inverted count of common shingles
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts[2000:])]
    column = {s: j for j, s in enumerate({s for x in sets for s in x})}
    dense = np.zeros((2000, len(column)), np.float32)
    for i, x in enumerate(sets):
        dense[i, [column[s] for s in x]] = 1
    common, size = dense @ dense.T, dense.sum(1)
    linked = 100 * common >= 80 * (size[:, None] + size[None] - common)
    of = np.array([got[i + 2000] for i in range(2000)])
    met = (of[:, None] == of[None]) & linked
    np.fill_diagonal(linked, False)
    np.fill_diagonal(met, False)
    assert met.sum() >= 0.999 * linked.sum() > 0
    first = {}
    for i in range(2000):  # and no component that links don't make
        first.setdefault(int(of[i]), []).append(i)
    for members in first.values():
        seen, todo = {members[0]}, [members[0]]
        while todo:
            for j in np.flatnonzero(linked[todo.pop()]).tolist():
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert set(members) <= seen


def test_split_buckets_keep_near_pairs(docs, monkeypatch):
    """With every mixed bucket split, links at 0.8 and more are still found."""
    draw = random.Random(7)
    texts = family(draw, 300, [f"w{i}" for i in range(3000)])
    whole = {r.doc_id: r.component_id for r in near_dedup.near_groups(docs(texts)).collect()}
    monkeypatch.setattr(near_dedup, "LARGE", 50)
    monkeypatch.setattr(near_dedup, "STARS", 1)
    split = {r.doc_id: r.component_id for r in near_dedup.near_groups(docs(texts)).collect()}
    assert sum(whole[i] == split[i] for i in range(300)) >= 297


def test_operators_pass_clashing_names_through(odd):
    from chatterflow.llm import exact_dedup

    for step in (exact_dedup.exact_dedup, near_dedup.near_dedup, mixing.mixed):
        assert step(odd).columns == odd.columns
        assert written(step(odd)).count() > 0
