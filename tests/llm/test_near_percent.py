"""Similarities other than 80 percent against brute force."""

import random

import pytest

from chatterflow.llm import near_dedup as N


def test_shapes():
    assert N.shape(80) == (64, 12) and N.shape(50)[1] == 3 and N.screen(80) == 373
    with pytest.raises(ValueError):
        N.shape(0)


def test_sixty_percent_equals_brute_force(spark):
    draw = random.Random(6)
    texts = []
    for i in range(30):
        words = [f"w{i}x{draw.randrange(10**6)}" for _ in range(100)]
        # from clearly above 0.6 to clearly below it, all with fewer words
        texts += [" ".join(words), " ".join(words[: 62 + i])] if i % 2 else [" ".join(words), " ".join(words[: 30 + i])]
    sets = [{tuple(w[j : j + 3]) for j in range(len(w) - 2)} for w in (t.split() for t in texts)]
    want = {b: a if 100 * len(sets[a] & sets[b]) >= 60 * len(sets[a] | sets[b]) else b for a, b in ((i, i + 1) for i in range(0, 60, 2))}
    assert len({b for b, a in want.items() if a != b}) > 10
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in N.near_groups(df, 3, 60).collect()}
    assert got == {i: want.get(i, i) for i in range(60)}
