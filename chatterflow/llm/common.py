"""What several operators share: tables written to the shared folder, and text batches as numpy arrays."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import shared_dir, written  # noqa: F401

#: White space of every word definition here: blank and \t \n \v \f \r.
SPACES = b" \t\n\x0b\x0c\r"
#: A row is held out of every fit when crc32(doc_id as text) % FOLDS is 0.
FOLDS = 5


def fresh(name: str) -> str:
    """A column name that no table has."""
    return f"{name}_{uuid.uuid4().hex}"


def held_out(doc_id: Column) -> Column:
    """False for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def drawn(share: Column | int, parts: int) -> Column:
    """True for about ``share`` of ``parts`` rows, by their place in the input: rows that repeat an id or a text are drawn apart."""
    return F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)) < share


def with_text(docs: DataFrame, *more: str) -> DataFrame:
    """Only doc_id, text and the named columns, so that scans stay narrow and clashing extra columns cannot matter."""
    return docs.select("doc_id", *more, F.col("text").cast("string").alias("text"))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts behind one another and the n + 1 offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, kind, len(texts) + 1, texts.offset * kind().itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, off - off[0]


def chunks(offsets: np.ndarray, size: int = 1 << 20, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Runs of documents [a, b) of about ``size`` bytes and at most ``most`` documents; a longer document makes a run of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        b = b if most is None else min(b, a + most)
        yield a, b
        a = b


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift, multiply), in place on a fresh array."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Keeps the first n of eight little-endian bytes.
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Runs of bytes longer than this are hashed one by one.
LONG = 256


def blocks(raw: np.ndarray) -> np.ndarray:
    """The eight little-endian bytes from every position on, as one number; zeros follow the end."""
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    return np.ndarray((len(raw) + 1,), "<u8", padded.data, strides=(1,))


def hash_runs(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every run of bytes [start, end): its blocks of eight bytes, each mixed in before the next.

    The mixing isn't linear, so no regular pattern of letters cancels out, as it would in a polynomial modulo 2**64.
    """
    at, length = blocks(raw), ends - starts
    left = np.minimum(length, 8)
    out = mix((at[starts] & _FIRST_BYTES[left]) + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    more = np.flatnonzero((length > 8) & (length <= LONG))
    done = 8
    while len(more):
        left = np.minimum(length[more] - done, 8)
        out[more] = mix(out[more] * np.uint64(0x9E3779B97F4A7C15) + (at[starts[more] + done] & _FIRST_BYTES[left]))
        done += 8
        more = more[length[more] > done]
    for i in np.flatnonzero(length > LONG):
        out[i] = np.frombuffer(hashlib.blake2b(raw[starts[i] : ends[i]].data, digest_size=8).digest(), "<u8")[0]
    return out


def words(raw: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word ``[^\\x20\\x09-\\x0D]+``, its 64-bit hash, and the n + 1 word offsets of the documents.

    ``lower`` folds A-Z before hashing.
    """
    starts, ends, off = word_bounds(raw, offsets)
    return starts, ends, hash_runs(_FOLD[raw] if lower else raw, starts, ends), off


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the word offsets of the documents."""
    n = len(raw)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_IS_SPACE[raw]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    cut = offsets[(offsets > 0) & (offsets < n)]
    before[cut] = False
    after[cut - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, offsets)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive words (across documents too; callers mask those)."""
    if len(hashes) < k:
        return np.empty(0, np.uint64)
    out = np.zeros(len(hashes) - k + 1, np.uint64)
    for i in range(k):  # a polynomial, so that no regular pattern of words cancels out
        out += hashes[i : len(hashes) - k + 1 + i]
        out *= np.uint64(0xA0761D6478BD642F)
    return mix(out)


def sums_per(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i + 1]] for every i, empty runs included."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
