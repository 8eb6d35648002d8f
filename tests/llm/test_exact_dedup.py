import hashlib
import re

from chatterflow.llm import exact_dedup as E


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    return {k: (min(v), len(v)) for k, v in groups.items()}


def test_groups_equal_brute_force(spark, docs):
    texts = ["a b", "a  b", "a\t\nb", " a b", "a b ", "a b", None, "", "x"] * 7 + ["hot"] * 300 + [f"t{i % 90}" for i in range(200)]
    df = docs(texts)
    want = brute(list(enumerate(texts)))
    for support in (0.001, 0.05):
        got = E.exact_groups(df.repartition(5), support).collect()
        assert len(got) == len(texts)
        for r in got:
            key = re.sub(r"[\x20\x09-\x0D]+", " ", texts[r.doc_id] or "")
            assert (r.keep_id, r.group_size) == want[key] and r.kept == (r.doc_id == r.keep_id)
            assert bytes(r.digest) == hashlib.sha256(key.encode()).digest()
        assert sorted(r.doc_id for r in E.exact_dedup(df, support).collect()) == sorted(i for i, _ in want.values())


def test_heavy_groups_are_found_and_bounded(docs):
    table = E.written(E.digests(docs(["hot"] * 500 + [str(i) for i in range(500)])))
    heavy = E.heavy_digests(table, 0.1).collect()
    assert [(r["first"].doc_id, r.group_size) for r in heavy] == [(0, 500)]


def test_odd_rows(odd, docs):
    got = E.exact_groups(odd).collect()
    assert len(got) == odd.count() and sum(r.kept for r in got) == len({bytes(r.digest) for r in got})
    kept = E.exact_dedup(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4, 5, 6]
    assert E.exact_groups(docs([]).limit(0)).collect() == [] and E.exact_dedup(docs([])).collect() == []


def test_no_python_in_the_plan(docs):
    plan = E.exact_dedup(docs(["a", "b"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
