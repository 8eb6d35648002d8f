"""Language id by a bit-sliced Bloom filter of byte n-grams.

Every cell of the filter is a bitmask of languages. An n-gram frequent in a language sets that language's bit in its k
cells; a lookup ANDs the k cells and so returns all languages that contain the n-gram at once. A document's per-language
popcounts over its n-grams, corrected for each language's false-positive rate fill**k, decide.

The filter is learned from a bounded sample of labelled rows (about ``train_rows`` of each language, drawn by their place in
the input), and only from rows that are not held out. Case is folded, ASCII non-letters are blanks, and each text is padded with
blanks. Null, empty and letterless texts get ``und`` and score 0; a text whose n-grams are all unknown gets the most
frequent learned language and score 0, as do ties between languages, which the larger one wins. Very long texts are one
chunk of their own; repeated rows are judged each; with no labelled row every text is ``und``. A row with a null doc_id is never held out. Languages may be any number; the
filter has 8 MB for each 64 of them. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, drawn, held_out, sums_per, text_bytes, with_text, written

#: Rows of each language to learn from, about; share of a language's sampled rows that must hold an n-gram.
TRAIN_ROWS, MIN_SHARE = 3000, 0.01
#: n-gram length in bytes, cells as a power of two, and hash functions.
N, BITS, K = 4, 20, 3
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)
_KEEP = np.full(256, 32, np.uint8)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


def padded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, offsets, and whether each text has a letter."""
    lower = pc.utf8_lower(pc.fill_null(texts, ""))
    raw, off = text_bytes(pc.binary_join_element_wise(" ", lower, "  ", ""))
    raw = _KEEP[raw]
    letters = sums_per(raw != 32, off) > 0
    plain = sums_per((raw >= 97) & (raw < 123), off) > 0
    for i in np.flatnonzero(letters & ~plain):  # beyond ASCII only: signs and letters look alike there
        letters[i] = any(map(str.isalpha, lower[int(i)].as_py()))
    return raw, off, letters


def grams(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all texts behind one another, and their offsets by text; padding leaves one for each text at least."""
    x = np.zeros(max(0, len(raw) - N + 1), np.uint64)
    for i in range(N):
        x |= raw[i : len(raw) - N + 1 + i].astype(np.uint64) << np.uint64(8 * i)
    inside = np.ones(len(x), bool)
    for i in range(1, N):
        at = off[1:-1] - i
        inside[at[at >= 0]] = False
    kept = np.flatnonzero(inside)
    return x[kept], np.searchsorted(kept, off)


def cells(x: np.ndarray, k: int = K, bits: int = BITS) -> list[np.ndarray]:
    return [((x * np.uint64(m)) >> np.uint64(64 - bits)).astype(np.int64) for m in _ODD[:k]]


class Filter:
    """Languages in order of their frequency, the cells, and each language's false-positive rate."""

    def __init__(self, langs: list[str], by_lang: list[np.ndarray]):
        kind = next((t for t, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32)) if len(langs) <= n), np.uint64)
        self.langs, self.width = langs, 8 * kind().itemsize
        self.tables = [np.zeros(1 << BITS, kind) for _ in range(0, max(1, len(langs)), self.width)]
        for i, x in enumerate(by_lang):
            for at in cells(x.astype(np.uint64)):
                self.tables[i // self.width][at] |= kind(1 << i % self.width)
        self.wrong = np.array([self.bit(self.tables, i).mean() ** K for i in range(len(langs))])

    def bit(self, masks: list[np.ndarray], i: int) -> np.ndarray:
        kind = self.tables[0].dtype.type
        return (masks[i // self.width] >> kind(i % self.width)) & kind(1)

    def masks(self, x: np.ndarray) -> list[np.ndarray]:
        """The languages of each n-gram, in as many words as they need."""
        first, *more = cells(x)
        out = [t[first] for t in self.tables]
        for at in more:
            out = [a & t[at] for a, t in zip(out, self.tables, strict=True)]
        return out

    def counts(self, x: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Corrected number of n-grams of each text that each language contains."""
        masks, n = self.masks(x), np.diff(off)[:, None]
        found = np.stack([sums_per(self.bit(masks, i), off) for i in range(len(self.langs))], 1)
        return np.clip((found - n * self.wrong) / (1 - self.wrong), 0, None)


def learn(docs: DataFrame, train_rows: int = TRAIN_ROWS, min_share: float = MIN_SHARE) -> Filter:
    """Fit on text and non-null lang of a bounded sample of the rows that aren't held out."""
    train = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    sizes = train.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()  # a row for each language
    if not sizes:
        return Filter([], [])
    langs = [r["lang"] for r in sizes]
    parts = 1_000_000
    share = F.create_map(*[F.lit(y) for r in sizes for y in (r["lang"], int(parts * min(1.0, train_rows / r["count"])))])
    sample = written(train.filter(drawn(share[F.col("lang")], parts)).select("lang", "text"))
    number = {name: i for i, name in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = np.array([number[v] for v in batch.column("lang").to_pylist()], np.int64)
            raw, off, _ = padded(batch.column("text"))
            for a, b in chunks(off):
                x, x_off = grams(raw[off[a] : off[b]], off[a : b + 1] - off[a])
                once = [np.unique(x[s:e]) | np.uint64(int(of[a + i]) << 8 * N) for i, (s, e) in enumerate(zip(x_off[:-1], x_off[1:], strict=True))]
                keys, n = np.unique(np.concatenate(once), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n)], names=["key", "n"])

    lang = F.shiftright("key", 8 * N)
    rows = sample.groupBy("lang").count().collect()
    least = F.create_map(*[F.lit(y) for r in rows for y in (number[r["lang"]], max(2.0 if r["count"] > 20 else 1.0, min_share * r["count"]))])
    kept = sample.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least[lang.cast("int")])
    keys = np.fromiter((r[0] for r in kept.select("key").toLocalIterator()), np.int64)
    return Filter(langs, [keys[keys >> 8 * N == i] & ((1 << 8 * N) - 1) for i in range(len(langs))])


def predict(docs: DataFrame, model: Filter) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_grams and the corrected popcount of the language that won."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.langs, "und"], object)
        for batch in batches:
            texts = batch.column("text")
            raw, offsets = text_bytes(texts)
            for a, b in chunks(offsets):
                raw_, off, letters = padded(texts.slice(a, b - a))
                x, x_off = grams(raw_, off)
                if model.langs:
                    found = model.counts(x, x_off)
                    best = found.argmax(1)
                    top, total = found.max(1), found.sum(1)
                else:
                    best, top, total = np.zeros(b - a, np.int64), np.zeros(b - a), np.zeros(b - a)
                    letters &= False
                score = np.where(letters & (total > 0), top / np.maximum(total, 1e-9), 0.0)
                pred = names[np.where(letters, best, len(model.langs))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[a:b], batch.column("held_out")[a:b], pa.array(pred, pa.string()), pa.array(score), pa.array(np.diff(x_off)), pa.array(top)],
                    names=["doc_id", "held_out", "lang_pred", "score", "n_grams", "n_found"],
                )

    out = "doc_id long, held_out boolean, lang_pred string, score double, n_grams long, n_found double"
    return with_text(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, out)
