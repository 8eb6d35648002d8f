"""What near_dedup holds and writes beside its result."""

import tracemalloc

import pyarrow as pa
import pytest

from chatterflow.llm import near_dedup as N


@pytest.mark.parametrize("texts", [[f"a{i} b c{i % 7} d e f{i}" for i in range(5000)], [" ".join(f"w{i * j % 9973}" for j in range(400)) for i in range(4000)]], ids=["short", "long"])
def test_a_batch_is_sketched_in_little_memory(texts, monkeypatch):
    class Docs:
        def mapInArrow(self, run, schema):
            return run

    monkeypatch.setattr(N, "with_text", lambda docs: Docs())
    monkeypatch.setattr(N, "written", lambda run: run)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    run, rows = N.sketched(None, 5, 80), 0
    tracemalloc.start()
    for out in run(iter([batch])):
        assert out.column("doc_id").to_pylist() == list(range(rows, rows + out.num_rows))
        rows += out.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(texts) and peak < 25 << 20


def test_few_tables_are_written(docs, monkeypatch):
    tables, write = [], N.written
    monkeypatch.setattr(N, "written", lambda df: tables.append(df) or write(df))
    base = [f"u{i}" for i in range(60)]
    texts = [" ".join(base), " ".join(base[:-1] + ["x"]), " ".join(base), "another text of six words here", ""]
    assert sorted(r.doc_id for r in N.near_dedup(docs(texts)).collect()) == [0, 3, 4]
    assert len(tables) <= 16
