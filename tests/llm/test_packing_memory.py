"""What packing's workers hold, and which workers it starts."""

import random
import tracemalloc

import pyarrow as pa
import pytest

from chatterflow.llm import packing
from chatterflow.llm.common import text_bytes


@pytest.fixture(scope="module")
def file():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def rare(n, draw):
    return ["".join(draw.choices("abcdefghij", k=9)) for _ in range(n)]


def test_a_worker_holds_little_however_many_words_it_meets(file):
    draw = random.Random(3)
    tracemalloc.start()
    by_table = packing.WordIds(file)
    for _ in range(24):
        by_table.ids(*text_bytes(pa.array([" ".join(rare(20_000, draw))])))
    text = " ".join(rare(1000, draw)) + " the end"
    ids, _ = by_table.ids(*text_bytes(pa.array([text])))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert ids.tolist() == [*by_table.whole.encode(text, add_special_tokens=False).ids, 0]
    assert held < 40 << 20


def test_frequent_words_stay_in_a_full_table(file, monkeypatch):
    by_table, draw, encoded = packing.WordIds(file, 10), random.Random(4), []
    encode = by_table.encode
    monkeypatch.setattr(by_table, "encode", lambda units: encoded.extend(units) or encode(units))
    common = [f"common{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
    for _ in range(60):
        words = rare(100, draw) + common + ["d\u014dn't"]
        draw.shuffle(words)
        ids, _ = by_table.ids(*text_bytes(pa.array([" ".join(words)])))
        assert ids.tolist() == [*by_table.whole.encode(" ".join(words), add_special_tokens=False).ids, 0]
    assert sum(w.startswith(b"common") for w in encoded) == len(common)


@pytest.mark.parametrize("broadcast_runs", [packing.BROADCAST_RUNS, 0])
def test_small_tables_need_no_python_workers(docs, file, spark, monkeypatch, broadcast_runs):
    """A list given to createDataFrame goes through workers that stay beside those of mapInArrow."""
    table = docs(["one two three", "", None, "word " * 5000])

    def parallelize(*a, **b):
        raise AssertionError("a list is sent through Python workers")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", parallelize)
    got = packing.pack(table, file, broadcast_runs=broadcast_runs).collect()
    assert sorted((r.doc_id, r.piece, r.length) for r in got) == [(0, 0, 4), (1, 0, 1), (2, 0, 1), (3, 0, 2048), (3, 1, 2048), (3, 2, 905)]
