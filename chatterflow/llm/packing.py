"""Best-fit packing of token pieces into sequences, in bulk-synchronous rounds.

1. Each text becomes token ids (an id 0 ends it), cut into pieces of ``capacity`` tokens only where it is longer.
2. The pieces are range-sorted by length, so that each has a rank among those of its length; only the counts per length and
   partition reach the driver (at most capacity + partitions rows, whatever the number of pieces).
3. Rounds: sizes are integers up to ``capacity``, so pieces of one length and gaps of one size are interchangeable classes.
   Going down the lengths, the pieces of a length sweep to the successor class, the smallest gaps that hold them. If more
   pieces than places meet there, the lowest ranks win; the rest go on to the next larger gaps, and at last open new sequences.
   The filled gaps are updated and the round repeats. A round handles whole classes at once, for millions of pieces as for
   one, and decides exactly as best-fit decreasing would. Its decisions are runs: ranks a..b of a length to sequences s..t.
4. Every piece finds its run by length and rank: in a map-side lookup while the runs are few (``BROADCAST_RUNS``), else by an
   equi-join on blocks of ranks.

Null text counts as empty: one token. Ties in length are broken by doc_id, then piece. Repeated rows are packed each. A very
long text gives many pieces from one task. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _FIRST_BYTES, _FOLD, SPACES, blocks, chunks, mix, text_bytes, with_text, word_bounds, written

CAPACITY = 2048
#: 2**TABLE_BITS cells of 23 bytes, half of them filled at most, for pre-tokens, and bytes of odd words that a worker keeps.
TABLE_BITS, OTHERS = 19, 30_000_000
#: Bytes of text that are turned into ids at once: a worker keeps much of the memory that the arrays beside them once took.
TEXT_BYTES = 1 << 18
#: Up to so many runs (about 40 bytes each) are looked up map-side, which is all that a capacity up to 8192 can have; beyond,
#: Spark joins them.
BROADCAST_RUNS = 500_000
#: Ranks of one block in that join.
BLOCK = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordIds:
    """Ids of texts, as the tokenizers library gives them, by a table of pre-tokens.

    The tokenizer lower-cases, drops white space and never joins across pre-tokens, so a text's ids are those of its
    pre-tokens: runs of letters, single digits, and runs of other signs, which numpy finds and lower-cases for ASCII and the
    letters of Latin-1. Words with anything else (other alphabets, control characters, an apostrophe before a letter, what may
    be a special token) go through the whole tokenizer, once each. Distinct pre-tokens are encoded many at a time, each
    ending with its end-of-word id.

    The table has open addressing; a cell's key is the pre-token's own bytes, 16 at most (longer ones are kept like odd
    words), so a hit is exact. When the table is full, only pre-tokens that were found again stay (:meth:`sift`); where that
    isn't room enough, it starts anew, from the pre-tokens of the present texts. A worker keeps the table from task to task.
    """

    def __init__(self, file: str, table_bits: int = TABLE_BITS):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(file)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.fast = Tokenizer(self.whole.model)  # the model is held once
        self.fast.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.whole.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        same = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.shown = {b: 256 + n for n, b in enumerate(i for i in range(256) if i not in same) if b != 32}
        self.bits = table_bits
        self.clear()

    def clear(self) -> None:
        """Empty tables; the pool of ids begins with id 0 at place 0."""
        self.low, self.high = (np.zeros(1 << self.bits, np.uint64) for _ in range(2))
        self.place, self.length = np.zeros(1 << self.bits, np.int32), np.zeros(1 << self.bits, np.uint16)
        self.again = np.zeros(1 << self.bits, bool)
        self.pool, self.used, self.known = np.zeros(1 << 20, "<u4"), 1, 0
        self.others: dict[bytes, tuple[int, int]] = {}
        self.kept_bytes = 0

    def sift(self) -> None:
        """Room in the table: only pre-tokens that were found again stay, if they aren't more than half of what it may hold."""
        kept, pool, others, kept_bytes = np.flatnonzero(self.again), self.pool, self.others, self.kept_bytes
        kept = kept[: len(kept) if len(kept) <= len(self.low) // 4 else 0]
        low, high, place, length = (x[kept] for x in (self.low, self.high, self.place, self.length))
        self.clear()
        size = length.astype(np.int64)
        before = np.cumsum(size) - size
        ids = pool[np.repeat(place - before, size) + np.arange(size.sum())]
        self.insert(low, high, self.pooled(ids) + before, length)
        if kept_bytes <= OTHERS:
            self.others = {w: (self.pooled(pool[at : at + n]), n) for w, (at, n) in others.items()}
            self.kept_bytes = kept_bytes

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The cell of each key, -1 for those that the table lacks."""
        at = _slot(low, high, self.bits)
        here = self.low[at]
        out = np.where((here == low) & (self.high[at] == high), at, -1)
        open_ = np.flatnonzero((out < 0) & (here != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.low) - 1)
            here, want = self.low[at[open_]], low[open_]
            hit = (here == want) & (self.high[at[open_]] == high[open_])
            out[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit & (here != 0)]
        return out

    def insert(self, low: np.ndarray, high: np.ndarray, place: np.ndarray, length: np.ndarray) -> None:
        """Distinct keys that the table lacks."""
        self.known += len(low)
        at, left = _slot(low, high, self.bits), np.arange(len(low))
        while len(left):
            free = left[self.low[at[left]] == 0]
            self.low[at[free]], self.high[at[free]] = low[free], high[free]
            # of several keys that met in one free cell the last one has it
            mine = (self.low[at[left]] == low[left]) & (self.high[at[left]] == high[left])
            self.place[at[left[mine]]], self.length[at[left[mine]]] = place[left[mine]], length[left[mine]]
            left = left[~mine]
            at[left] = (at[left] + 1) & (len(self.low) - 1)

    def pooled(self, ids: np.ndarray) -> int:
        """The place of ids that are put into the pool."""
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(len(self.pool) + len(ids), "<u4")))
        at, self.used = self.used, self.used + len(ids)
        self.pool[at : self.used] = ids
        return at

    def encode(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of lower-cased pre-tokens behind one another, and how many each has."""
        lines = [b" ".join(units[i : i + 1000]) for i in range(0, len(units), 1000)]
        lines = [x.decode() if x.isascii() else x.decode("latin-1").translate(self.shown) for x in lines]
        found = [np.array(e.ids, "<u4") for e in self.fast.encode_batch_fast(lines, add_special_tokens=False)]
        ids = np.concatenate(found)
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(units):
            raise ValueError("a pre-token without one end-of-word id")
        return ids, np.diff(last, prepend=-1)

    def ids(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts behind one another, each ended by id 0, and their n + 1 offsets."""
        begins, ends, other, folded, off = units(raw, offsets)
        plain = np.flatnonzero(~other)
        at, length = blocks(folded), ends[plain] - begins[plain]
        low = at[begins[plain]] & _FIRST_BYTES[np.minimum(length, 8)]
        high = at[np.minimum(begins[plain] + 8, len(raw))] & _FIRST_BYTES[np.maximum(length - 8, 0)]
        cells, missed, first = self._missed(low, high)
        self.again[cells[cells >= 0]] = True
        for make_room in (self.sift, self.clear):
            if self.known + len(first) > len(self.low) // 2 or self.kept_bytes > OTHERS:
                make_room()
                cells, missed, first = self._missed(low, high)
        if len(first) > len(self.low) // 2:  # more distinct ones in one giant text than the table is for
            return self._once(raw, offsets)
        place, size = np.zeros(len(begins), np.int64), np.zeros(len(begins), np.int64)
        if len(missed):
            data = folded.tobytes()
            beyond = blocks_beyond_ascii(low[missed[first]]) | blocks_beyond_ascii(high[missed[first]])
            first = first[np.argsort(beyond, kind="stable")]  # lines of ASCII alone need no translation
            which = plain[missed[first]]
            ids, many = self.encode([data[a:b] for a, b in zip(begins[which].tolist(), ends[which].tolist(), strict=True)])
            places = self.pooled(ids) + np.cumsum(many) - many
            self.insert(low[missed[first]], high[missed[first]], places, many)
            cells = self.find(low, high)
        place[plain], size[plain] = self.place[cells], self.length[cells]
        odd = np.flatnonzero(other)
        if len(odd):
            data = raw.tobytes()
            words_ = [data[a:b] for a, b in zip(begins[odd].tolist(), ends[odd].tolist(), strict=True)]
            new = list(set(words_).difference(self.others))
            for w, e in zip(new, self.whole.encode_batch_fast([w.decode() for w in new], add_special_tokens=False), strict=True):
                self.others[w] = self.pooled(np.array(e.ids, "<u4")), len(e.ids)
                self.kept_bytes += 100 + len(w)
            at_odd = np.array([self.others[w] for w in words_], np.int64)
            place[odd], size[odd] = at_odd[:, 0], at_odd[:, 1]
        place, size = np.insert(place, off[1:], 0), np.insert(size, off[1:], 1)
        total = np.concatenate(([0], np.cumsum(size)))
        out = self.pool[np.repeat(place - total[:-1], size) + np.arange(total[-1])]
        return out, total[off + np.arange(len(off))]

    def _missed(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The cell of each key, where the table lacks a key, and which of those places are the first of their key."""
        cells = self.find(low, high)
        missed = np.flatnonzero(cells < 0)
        return cells, missed, distinct(low[missed], high[missed])

    def _once(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same by a table for these texts alone, as large as they need."""
        bits, self.bits = self.bits, max(self.bits, int(len(raw)).bit_length() + 1)
        self.clear()
        out = self.ids(raw, offsets)
        self.bits = bits
        self.clear()
        return out


def _slot(low: np.ndarray, high: np.ndarray, bits: int) -> np.ndarray:
    return (mix(low + mix(high) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def blocks_beyond_ascii(x: np.ndarray) -> np.ndarray:
    return (x & np.uint64(0x8080808080808080)) != 0


def distinct(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Where each distinct key is first found."""
    order = np.lexsort((low, high))
    new = np.ones(len(order), bool)
    new[1:] = (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])
    return order[new]


def units(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every pre-token or odd word, whether the latter, the lower-cased bytes, and offsets by document."""
    kind, folded = _KIND[raw], _FOLD[raw]
    after = np.flatnonzero(raw[:-1] == 0xC3) + 1 if len(raw) else np.empty(0, np.int64)
    if len(after):  # letters of Latin-1, but for the signs of multiplication and division
        second = raw[after]
        kind[after] = np.where((second == 0x97) | (second == 0xB7), _ODD, _LETTER)
        folded[after[(second < 0x9F) & (second != 0x97)]] += 32
    starts, ends, word_off = word_bounds(raw, offsets)
    if not len(starts):
        return starts, ends, np.zeros(0, bool), folded, word_off
    strange = kind == _ODD
    strange[:-1] |= ((raw[:-1] == 39) & (kind[1:] == _LETTER)) | ((raw[:-1] == 60) & (raw[1:] == 124))
    odd = np.zeros(len(starts), bool)
    odd[np.searchsorted(starts, np.flatnonzero(strange), "right") - 1] = True
    cut = kind == _DIGIT
    cut[1:] |= kind[1:] != kind[:-1]
    cut &= kind != _BLANK
    cut[starts] = True
    begins = np.flatnonzero(cut)
    word = np.searchsorted(starts, begins, "right") - 1
    kept = ~odd[word] | (begins == starts[word])
    begins, word = begins[kept], word[kept]
    stop = np.minimum(np.append(begins[1:], len(raw)), ends[word])
    return begins, stop, odd[word] | (stop - begins > 16), folded, np.searchsorted(begins, offsets)


#: One for each tokenizer file; a worker keeps it from task to task.
_IDS: dict[str, WordIds] = {}
_BLANK, _LETTER, _DIGIT, _SIGN, _ODD = range(5)
_KIND = np.full(256, _ODD, np.uint8)
_KIND[33:127] = _SIGN
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _KIND[0xC3] = _LETTER
_KIND[list(SPACES)] = _BLANK


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_file not in _IDS:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            _IDS[tokenizer_file] = WordIds(tokenizer_file)
        by_word, width = _IDS[tokenizer_file], 4 * capacity
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            raw, offsets = text_bytes(batch.column("text"))
            doc_ids = batch.column("doc_id").to_pylist()
            for a, b in chunks(offsets, TEXT_BYTES):
                ids, at_doc = by_word.ids(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                data, bounds = memoryview(ids).cast("B"), (at_doc * 4).tolist()
                for doc_id, s, e in zip(doc_ids[a:b], bounds[:-1], bounds[1:], strict=True):
                    for i, at in enumerate(range(0, e - s, width)):
                        part = data[s + at : min(e, s + at + width)]
                        for column, value in zip(out, (doc_id, i, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return with_text(docs).mapInArrow(run, PIECES)


def most_runs(capacity: int) -> int:
    return 3 * capacity * (capacity.bit_length() + 2)


def rounds(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Runs (length, first rank, first sequence, pieces a sequence, first offset), given the number of pieces of each length.

    gaps: by size, runs of sequences (first, how many) filled alike. A length uses up gap runs whole, but for the last one, which
    leaves three runs at most; and a gap run that a length uses up is less than half as large after it. So there are no more than
    3 * capacity * (log2(capacity) + 2) runs, however many pieces: :func:`most_runs`.
    """
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
    sizes: list[int] = []
    runs, opened = [], 0

    def update(size: int, first: int, many: int) -> None:
        if size and many:
            if not gaps[size]:
                bisect.insort(sizes, size)
            gaps[size].append((first, many))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(sizes, length)
            if at < len(sizes):
                gap = sizes[at]
                first, many = gaps[gap].pop()
                if not gaps[gap]:
                    sizes.pop(at)
            else:
                gap, first, many = capacity, opened, -(-left // (capacity // length))
                opened += many
            each = gap // length
            full = min(many, left // each)
            rest = min(left - full * each, each) if full < many else 0
            used = full + (rest > 0)
            runs.append((length, rank, first, each, capacity - gap))
            update(gap - each * length, first, full)
            update(gap - rest * length, first + full, used - full)
            update(gap, first + used, many - used)
            rank += full * each + rest
            left -= full * each + rest
    return np.array(runs, np.int64).reshape(-1, 5)


def ranked(table: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """The pieces with their rank within their length, and the number of pieces of each length."""
    ordered = table.repartitionByRange(F.desc("length"), "doc_id", "piece").sortWithinPartitions(F.desc("length"), "doc_id", "piece")
    placed = written(ordered.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    inside = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    seen = placed.groupBy(part.alias("part"), "length").agg(F.count(F.lit(1)).alias("n"), F.min(inside).alias("first")).orderBy("part", "length").collect()
    counts: dict[int, int] = defaultdict(int)
    base = []
    for r in seen:
        base.append((r["part"], r["length"], counts[r["length"]] - r["first"]))
        counts[r["length"]] += r["n"]
    if not base:
        return placed.select("*", F.lit(0).cast("long").alias("rank")), {}
    # from Arrow, since a list would pass through Python workers of another kind, which stay beside the first
    shift = placed.sparkSession.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in zip(*base, strict=True)], names=["part", "length", "shift"]))
    with_rank = placed.withColumn("part", part).join(F.broadcast(shift), ["part", "length"]).withColumn("rank", inside + F.col("shift"))
    return with_rank.drop("part", "shift"), dict(counts)


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, broadcast_runs: int = BROADCAST_RUNS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    placed, counts = ranked(written(pieces(docs, tokenizer_file, capacity)))
    runs = rounds(counts, capacity)
    out = f"{PIECES}, sequence_id long, offset long"
    columns = [x.split()[0] for x in PIECES.split(", ")]
    placed = placed.select(*columns, "rank")
    if len(runs) > broadcast_runs:
        return _joined(placed, runs, counts).select(*columns, "sequence_id", "offset")
    order = np.lexsort((runs[:, 1], runs[:, 0])) if len(runs) else []
    shared = docs.sparkSession.sparkContext.broadcast(runs[order])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        keys = (table[:, 0] << 48) + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            _, first, sequence, each, offset = table[np.searchsorted(keys, (length << 48) + rank, "right") - 1].T
            nth = rank - first
            more = [pa.array(sequence + nth // each), pa.array(offset + nth % each * length)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *more], names=[*columns, "sequence_id", "offset"])

    return placed.mapInArrow(run, out)


def _joined(placed: DataFrame, runs: np.ndarray, counts: dict[int, int]) -> DataFrame:
    """The same lookup as a join on length and block of ranks, for more runs than should be broadcast."""
    order = np.lexsort((runs[:, 1], runs[:, 0]))
    runs = runs[order]
    last = np.append(runs[1:, 1], 0)
    ends = np.append(runs[1:, 0] != runs[:-1, 0], True)
    last[ends] = [counts[int(x)] for x in runs[ends, 0]]
    table = placed.sparkSession.createDataFrame(pa.table([pa.array(c) for c in (*runs.T, last)], names=["r_length", "first", "sequence", "each", "r_offset", "last"]))
    table = table.withColumn("block", F.explode(F.sequence(F.expr(f"first div {BLOCK}"), F.expr(f"(last - 1) div {BLOCK}"))))
    found = (F.col("length") == F.col("r_length")) & (F.expr(f"rank div {BLOCK}") == F.col("block")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))
    nth = F.col("rank") - F.col("first")
    return placed.join(table, found).withColumn("sequence_id", F.col("sequence") + F.expr("(rank - first) div each")).withColumn("offset", F.col("r_offset") + nth % F.col("each") * F.col("length"))
