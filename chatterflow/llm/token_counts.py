"""Token counts by a map-side two-tier lookup, without shuffling the corpus's pre-tokens.

A sentencepiece model of this kind has no piece that goes on across the blank mark, other than runs of blanks, so a text's
count is the sum over its pre-tokens: a run of blanks and what follows up to the next blank, cut also before each line
break, which no piece contains. :func:`check_model` verifies both properties, and that texts aren't normalised, on the model.
Texts that hold the blank mark itself (U+2581), which merges with blanks beside it, go to the library whole.

Tier one: frequent pre-tokens and their lengths in an open-addressing table, broadcast once; its size is fixed by
``table_bits``, and its keys are the pre-tokens' own bytes, 16 at most, so a hit is exact. They are counted, map-side first,
over the whole texts of about ``SAMPLE_ROWS`` rows drawn from all partitions by a hash of doc_id; the sample only moves work
between the tiers and never changes a count. Tier two: pre-tokens that miss are encoded once per worker and kept in a bounded
cache.

Null and empty texts have no tokens. Texts with runs of blanks, or blanks at either end, take the same lookup on their runs. A
very long text is one chunk of its own. Repeated rows are counted each; ties in frequency only decide which tier a pre-token
is in; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _FIRST_BYTES, blocks, chunks, drawn, mix, sums_per, text_bytes, with_text

#: Rows, about, in which frequent pre-tokens are counted, and 2**TABLE_BITS cells of 17 bytes in the broadcast table.
SAMPLE_ROWS, TABLE_BITS = 4000, 17
#: Pre-tokens that one worker keeps beyond the table; the cache is emptied when full.
CACHE = 700_000
#: Bytes of a pre-token in the table at most.
WIDTH = 16
#: The model and its cache by file; a worker keeps them from task to task.
_WORKER: dict = {}
_MARK = np.frombuffer("▁".encode(), np.uint8)


def check_model(processor) -> None:
    """Raise unless pre-tokens can be counted apart from one another."""
    if processor.normalize("  Ａ é") != "▁▁▁Ａ▁é":
        raise ValueError("the model normalises texts")
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        if "\n" in piece or ("▁" in piece[1:] and piece.strip("▁")):
            raise ValueError(f"piece {piece!r} crosses a pre-token boundary")


def count_pieces(processor, pre: list[bytes]) -> list[int]:
    """Tokens of pre-tokens as they stand in a text: behind a blank, or behind a line break.

    The encoder itself puts one blank mark in front, which stands for the pre-token's first blank; a pre-token that begins
    with a line break has none, so one token is taken off.
    """
    texts = [p[1:].decode() if p[:1] == b" " else p.decode() for p in pre]
    counts = [len(x) for x in processor.encode(texts, num_threads=1)]
    return [1 if p == b" " else c - (p[:1] == b"\n") for p, c in zip(pre, counts, strict=True)]


def pre_tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Data with one blank put before each non-empty text, then start, end and per-document offsets of its pre-tokens."""
    n = np.diff(offsets)
    full = np.flatnonzero(n > 0)
    data = np.insert(raw, offsets[full], 32)
    off = offsets + np.concatenate(([0], np.cumsum(n > 0)))
    blank = data == 32
    begins = data == 10
    begins[1:] |= blank[1:] & ~blank[:-1]
    begins[off[:-1][full]] = True
    starts = np.flatnonzero(begins)
    return data, starts, np.append(starts[1:], len(data))[: len(starts)], np.searchsorted(starts, off)


def keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each pre-token as two numbers; zeros for those that are too long or hold a zero byte."""
    at, length = blocks(data), ends - starts
    fits = length <= WIDTH
    zeros = np.flatnonzero(data == 0)
    if len(zeros) and len(starts):
        fits[np.maximum(np.searchsorted(starts, zeros, "right") - 1, 0)] = False
    low = np.where(fits, at[starts] & _FIRST_BYTES[np.minimum(length, 8)], np.uint64(0))
    return low, np.where(fits, at[np.minimum(starts + 8, len(data))] & _FIRST_BYTES[np.clip(length - 8, 0, 8)], np.uint64(0))


def places(low: np.ndarray, high: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two cells that a key may be in."""
    h = mix(low + mix(high) * np.uint64(0x9E3779B97F4A7C15))
    return (h >> np.uint64(64 - bits)).astype(np.int64), (h & np.uint64((1 << bits) - 1)).astype(np.int64)


def build_table(pre: list[bytes], counts: list[int], bits: int = TABLE_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and lengths in an open-addressing table with two places per key; what finds none is left to the second tier."""
    low, high, lengths = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint8)
    ends = np.cumsum([len(p) for p in pre], dtype=np.int64)
    a, b = keys(np.frombuffer(b"".join(pre), np.uint8), np.concatenate(([0], ends[:-1])).astype(np.int64), ends) if pre else (low[:0], low[:0])
    for x, y, c, *at in zip(a.tolist(), b.tolist(), counts, *(p.tolist() for p in places(a, b, bits)), strict=True):
        for place in at:
            if x and c < 256 and not low[place]:
                low[place], high[place], lengths[place] = x, y, c
                break
    return low, high, lengths


def frequent(docs: DataFrame, many: int, sample_rows: int = SAMPLE_ROWS) -> list[bytes]:
    """The ``many`` most frequent pre-tokens of a sample over all partitions."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column("text"))
            for a, b in chunks(offsets):
                data, starts, ends, _ = pre_tokens(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                whole = data.tobytes()
                seen = Counter(whole[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True) if e - s <= WIDTH)
                yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["pre", "n"])

    parts = 1_000_000
    share = int(parts * min(1.0, sample_rows / max(1, docs.count())))
    sample = docs.filter(drawn(share, parts)).select("text")
    counted = sample.mapInArrow(count, "pre binary, n long").groupBy("pre").agg(F.sum("n").alias("n"))
    return [bytes(r["pre"]) for r in counted.orderBy(F.desc("n"), "pre").limit(many).collect()]


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096, sample_rows: int = SAMPLE_ROWS, table_bits: int = TABLE_BITS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every text under the sentencepiece model at ``model_file``."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=model_file)
    check_model(processor)
    narrow = with_text(docs)
    pre = frequent(narrow, (1 << table_bits) // 2, sample_rows)
    table = docs.sparkSession.sparkContext.broadcast(build_table(pre, count_pieces(processor, pre), table_bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        if model_file not in _WORKER:
            _WORKER[model_file] = sentencepiece.SentencePieceProcessor(model_file=model_file), {}
        local, cache = _WORKER[model_file]
        known_low, known_high, lengths = table.value
        for batch in batches:
            raw, offsets = text_bytes(batch.column("text"))
            for a, b in chunks(offsets):
                some, off = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                data, starts, ends, per_doc = pre_tokens(some, off)
                low, high = keys(data, starts, ends)
                n, found, known = np.zeros(len(starts), np.int64), np.zeros(len(starts), bool), low != 0
                for at in places(low, high, table_bits):
                    hit = known & (known_low[at] == low) & (known_high[at] == high)
                    n[hit] = lengths[at[hit]]
                    found |= hit
                missed = np.flatnonzero(~found)
                if len(missed):
                    whole = data.tobytes()
                    pre = [whole[s:e] for s, e in zip(starts[missed].tolist(), ends[missed].tolist(), strict=True)]
                    new = list(set(pre).difference(cache))
                    if len(cache) + len(new) > CACHE:
                        cache.clear()
                        new = list(set(pre))
                    cache.update(zip(new, count_pieces(local, new), strict=True))
                    n[missed] = [cache[p] for p in pre]
                total = sums_per(n, per_doc)
                marks = np.flatnonzero((some[:-2] == _MARK[0]) & (some[1:-1] == _MARK[1]) & (some[2:] == _MARK[2]))
                for i in np.unique(np.searchsorted(off, marks, "right") - 1):
                    total[i] = len(local.encode(batch.column("text")[a + int(i)].as_py()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[a:b], pa.array(np.diff(offsets[a : b + 1])), pa.array(total), pa.array(total > limit)],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return narrow.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
