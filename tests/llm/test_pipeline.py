import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from test_brute_force import loop_draws
from test_packing_mixing_urls import best_fit_decreasing, check_packed

import corpus_pipeline
from chatterflow.llm import exact_dedup, mixing, near_dedup, toxicity
from chatterflow.llm.common import written

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_and_chain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.score(docs, lexicon).filter("predicted = 1").collect()}
    step, kept = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, step, SF))
        assert out.columns == docs.columns, name
        kept.append((step, out))
        step = out
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(kept[0][1]) == ids(docs) - toxic
    assert ids(kept[1][1]) == {r.doc_id for r in exact_dedup.exact_groups(kept[1][0]).filter("kept").collect()}
    assert ids(kept[2][1]) == {r.doc_id for r in near_dedup.near_groups(kept[2][0]).filter("kept").collect()}
    times = {r.doc_id: r["count"] for r in mixing.mix_sources(kept[3][0]).groupBy("doc_id").count().collect()}
    assert {r.doc_id: r["count"] for r in kept[3][1].groupBy("doc_id").count().collect()} == times
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == ids(kept[3][1])
    assert sum(r.piece == 0 for r in packed) == sum(times.values())


def test_stages_on_odd_rows(spark, odd, docs, tmp_path):
    """Nulls in all columns, null ids, repeated rows, clashing names, very long texts; and empty tables."""
    none = odd.limit(1).select(*(F.lit(None).cast(t).alias(c) for c, t in odd.dtypes))
    again = odd.filter("doc_id = 6").withColumn("doc_id", F.lit(None).cast("long"))
    rows = odd.unionByName(none).unionByName(again)
    labels = "doc_id long, quality int, toxic int"
    for name, table in (("odd", rows), ("empty", rows.limit(0))):
        sf = str(tmp_path / name)
        table.write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(3, 1, None), (None, 1, 1), (4, 0, 0), (4, 0, 7), (99, 1, 1)] if name == "odd" else [], labels).write.parquet(f"{sf}/labels.parquet")
        step, sizes = spark.read.parquet(f"{sf}/documents.parquet"), []
        for stage, f in corpus_pipeline.STAGES[:-1]:
            step = written(f(spark, step, sf))
            assert step.columns == rows.columns, stage
            sizes.append(step.count())
        packed = corpus_pipeline.run(spark, sf).collect()
        if name == "empty":
            assert sizes == [0] * 4 and packed == []
        else:
            # of seven texts, each twice, and a null one and a copy with null ids: null, "" and blanks are two groups
            assert sizes[0] >= 12 and 4 <= sizes[1] <= 6 and sizes[2] == sizes[1] and packed


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def naive_score(lexicon, text):
    """Every term tried at every place."""
    folded, best, harmless = toxicity.fold(text or ""), {}, []
    for phrase in lexicon.exceptions:
        at = folded.find(f" {phrase} ")
        while at >= 0:
            harmless.append((at, at + len(phrase) + 1))
            at = folded.find(f" {phrase} ", at + 1)
    for term, w in lexicon.weights.items():
        at = folded.find(term)
        while at >= 0:
            best[at] = max(best.get(at, 0.0), w)
            at = folded.find(term, at + 1)
    total = sum(w for at, w in best.items() if not any(a <= at < b for a, b in harmless))
    a, b = lexicon.curve
    return 1 / (1 + np.exp(-np.clip(a + b * total / np.log2(2 + len(folded) / 500), -30, 30)))


def test_run_equals_brute_force(spark, tmp_path):
    """All five stages over one table, in plain Python but for the lexicon's weights and the hashes that order the draws."""
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id < 350")
    sf = str(tmp_path / "sf")
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.01/labels.parquet").write.parquet(f"{sf}/labels.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    lexicon = toxicity.learn(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    kept = {i: r for i, r in rows.items() if naive_score(lexicon, r.text) < 0.5}
    assert 0 < len(rows) - len(kept) < 60
    first = {}
    for i in sorted(kept):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", kept[i].text or ""), i)
    single = sorted(first.values())
    assert len(single) < len(kept)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i in single:
        w = WORD.findall((kept[i].text or "").translate(lower))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    group = {i: i for i in single}
    for n, i in enumerate(single):
        for j in single[n + 1 :]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((group[i], group[j]))
                group = {k: a if g == b else g for k, g in group.items()}
    alone = [i for i in single if group[i] == i]
    assert len(alone) < len(single)
    table = mixing.measured(docs.filter(F.col("doc_id").isin(alone)))
    drawn, _ = loop_draws(spark, table, mixing.plan(table), passes=12)
    times = Counter(d for d, _, _, _ in drawn.elements())
    lib, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for i, n in times.items():
        ids = np.array([*lib.encode(rows[i].text or "", add_special_tokens=False).ids, 0], "<u4")
        want.update({(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())): n for k in range(0, len(ids), 2048)})
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert check_packed(got) == best_fit_decreasing([r.length for r in got], 2048)
