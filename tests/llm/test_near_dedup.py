import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatterflow.llm import near_dedup as N


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(texts, k, percent=80):
    sets, parent = [shingles(t, k) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def corpus():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(4000)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    shared = prose(60)
    out = [" ".join(prose(100) + shared) for _ in range(40)]
    for _ in range(4):  # families: copies of a base, some of them far from one another; chains of copies of copies
        base = prose(150)
        for n in range(25):
            copy = base[:]
            for _ in range(n % 4):
                copy[rng.randrange(150)] = "edited"
            out.append(" ".join(copy))
        for n in range(12):
            base = base[3:] + prose(3)
            out.append(" ".join(base).upper() if n % 2 else "\t".join(base))
    return out + ["a", "A ", "a b c", "", None, "x y z v", "x  y\nz v", "x y z w"]


def test_components_equal_brute_force(docs):
    texts = corpus()
    want, sizes = brute(texts, 4)
    got = {r.doc_id: r for r in N.near_groups(docs(texts).repartition(4), k=4).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].kept for i in range(len(texts))] == [want[i] == i for i in range(len(texts))]
    assert sorted(r.doc_id for r in N.near_dedup(docs(texts)).collect()) == sorted(set(brute(texts, 5)[0]))


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(1)
    for n, common in ((1, 1), (2, 1), (40, 35), (2000, 1778)):
        errors = []
        for _ in range(20):
            u = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
            a, b = np.sort(u[:n]), np.sort(np.concatenate((u[:common], u[n : 2 * n - common])))
            s = N.sketch([a, b, np.empty(0, np.uint64)])
            assert (s[:2] != np.uint64(2**64 - 1)).all() and (s[2] == np.uint64(2**64 - 1)).all()
            errors.append((s[0] == s[1]).mean() - common / (2 * n - common))
        assert abs(np.mean(errors)) < 0.03


def test_regular_word_patterns_do_not_collide():
    t = "a b b a a b b a b a a b b a b a a a b b b a a a".encode()
    got = N.shingle_sets(np.frombuffer(t, np.uint8), np.array([0, len(t)]), 4)[0]
    assert len(got) == len(shingles(t.decode(), 4))


@pytest.mark.parametrize("cell", [1 << 22, 500])
def test_a_large_bucket_loses_no_pair(docs, monkeypatch, cell):
    """400 pairs of 0.80, and 200 texts that share most shingles with others but no such pair, in one bucket; stars find none."""
    draw = random.Random(11)
    pool, texts = [f"p{i}" for i in range(160)], []
    for i in range(400):
        words = draw.sample([f"w{j}" for j in range(9000)], 111)
        texts += [" ".join(words[:100]), " ".join(words[11:])]
    texts += [" ".join(draw.sample(pool, 100)) for _ in range(200)]
    sets = [set(t.split()) for t in texts]
    want = [i - i % 2 if i < 800 else i for i in range(1000)]
    assert all(100 * len(sets[i] & sets[i + 1]) >= 80 * len(sets[i] | sets[i + 1]) for i in range(0, 800, 2))
    assert not any(100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(sets[800:]) for b in sets[800 : 800 + i])
    table = docs(texts).repartition(4)
    own = N.sketched(table, 1, 80).select(F.col("doc_id").alias("doc"), "n_shingles", "sketch", "bits")
    ids = own.select("doc")
    monkeypatch.setattr(N, "_star", lambda members, led=None: (members.select(F.col("doc").alias("a"), F.col("doc").alias("b")).limit(0), members.select("doc").limit(0)))
    monkeypatch.setattr(N, "CELL", cell, raising=False)
    got = {r.node: r.label for r in N._labels(ids.select(F.lit(1).cast("long").alias("bucket"), "doc"), ids, own, table, 1, 80).collect()}
    assert [got.get(i, i) for i in range(1000)] == want


def test_odd_rows(odd, docs):
    got = N.near_groups(odd, 4).collect()
    assert len(got) == odd.count() and all(r.kept == (r.component_id == r.doc_id) for r in got)
    assert N.near_dedup(odd).columns == odd.columns
    assert N.near_groups(docs([])).collect() == [] and N.near_dedup(docs([])).collect() == []
