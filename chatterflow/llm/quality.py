"""Quality rules by repetition coverage: rolling hashes of several n-gram lengths in numpy, per Arrow batch.

For each document: the characters inside n-grams (3, 5, 7 and 10 words) that occur at least twice in it, and inside lines
equal to an earlier line. A text whose covered share passes the limit of any length is not kept. Longer n-grams are looked
for only where a shorter one repeats, since a repeated 5-gram begins with a repeated 3-gram; clean texts cost one sort.

Null and empty texts have no words and fail the base rule (fewer than 50 words). A very long text is one chunk of its own,
with memory in proportion to it. Ties don't matter: all occurrences of a repeated n-gram count, and of equal lines all but the
first. Repeated rows and ids are judged each on their own; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import _IS_SPACE, chunks, hash_runs, sums_per, text_bytes, windows, with_text, words

#: Largest share of word characters inside repeated n-grams, by n-gram length, and inside repeated lines.
LIMITS = {5: 0.15, 7: 0.13, 10: 0.10}
LINE_LIMIT = 0.20
BASE_N, MIN_WORDS = 3, 50
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: Not a continuation byte, so a character's first byte.
_LEAD = (np.arange(256) & 0xC0) != 0x80

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, " + ", ".join(f"dup_chars_{n} long" for n in LIMITS) + ", dup_line_chars long"


def repeated(keys: np.ndarray) -> np.ndarray:
    """Mask of the keys that occur more than once."""
    if len(keys) < 2:
        return np.zeros(len(keys), bool)
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(twice, keys)
    at[at == len(twice)] = 0
    return twice[at] == keys


def covered(hashes: np.ndarray, doc_of: np.ndarray, n: int, among: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Mask of the words inside n-grams that repeat within their document, and the starts of those n-grams.

    ``among``: starts that may repeat; None stands for all.
    """
    mask, last = np.zeros(len(hashes), bool), len(hashes) - n
    starts = np.arange(max(0, last + 1)) if among is None else among[among <= last]
    starts = starts[doc_of[starts] == doc_of[starts + n - 1]]
    if not len(starts):
        return mask, starts
    grams = windows(hashes, n)[starts] if among is None else np.array([], np.uint64)
    if among is not None:
        grams = np.zeros(len(starts), np.uint64)
        for i in range(n):
            grams = (grams + hashes[starts + i]) * np.uint64(0x9E3779B97F4A7C15)
            grams ^= grams >> np.uint64(29)
    grams = grams + doc_of[starts].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    starts = starts[repeated(grams)]
    for i in range(n):
        mask[starts + i] = True
    return mask, starts


def repeated_lines(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each document its lines with a word that equal an earlier line, by their hash, and the characters of their words."""
    breaks, full = np.flatnonzero(data == 10), np.diff(off) > 0
    starts = np.unique(np.concatenate((off[:-1][full], breaks + 1)))
    starts = starts[starts < len(data)]
    doc = np.searchsorted(off, starts, "right") - 1
    ends = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, starts)], off[doc + 1])
    inside = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~_IS_SPACE[data] & _LEAD[data], out=inside[1:])
    chars = inside[ends] - inside[starts]
    some = np.flatnonzero(chars)
    starts, ends, doc, chars = starts[some], ends[some], doc[some], chars[some]
    keys = hash_runs(data, starts, ends) + doc.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    again = np.ones(len(keys), bool)
    again[np.unique(keys, return_index=True)[1]] = False
    n = len(off) - 1
    return np.bincount(doc[again], minlength=n), np.bincount(doc[again], chars[again], n).astype(np.int64)


def measure(ids: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    raw, offsets = text_bytes(texts)
    for a, b in chunks(offsets):
        data, off = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, hashes, word_off = words(data, off)
        n_words = np.diff(word_off)
        doc_of = np.repeat(np.arange(b - a), n_words)
        lead = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_LEAD[data], out=lead[1:])
        length = lead[ends] - lead[starts]
        word_chars = sums_per(length, word_off)
        base, at = covered(hashes, doc_of, BASE_N, None)
        n_repeat = sums_per(base, word_off)
        dup = {}
        for n in LIMITS:
            mask, at = covered(hashes, doc_of, n, at)
            dup[n] = sums_per(length * mask, word_off)
        n_lines, line_chars = repeated_lines(data, off)
        failed = (n_words < MIN_WORDS) | (100 * n_repeat > 50 * n_words)
        over = line_chars > LINE_LIMIT * word_chars
        for n, limit in LIMITS.items():
            over |= dup[n] > limit * word_chars
        columns = [n_words, word_chars, sums_per(_SYMBOL[data], off), n_lines, n_repeat, failed, ~failed & ~over, *dup.values(), line_chars]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays([ids[a:b], *map(pa.array, columns)], names=names)


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document: the base counts, the covered characters by n-gram length, and the verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from measure(batch.column("doc_id"), batch.column("text"))

    return with_text(docs).mapInArrow(run, SCHEMA)
