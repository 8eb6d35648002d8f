"""Near-duplicate documents by MinHash: fast similarity sketches, banding, and exact verification on full shingle sets.

Sketching follows Dahlgaard, Knudsen and Thorup, "Fast similarity sketching": in round i every shingle is thrown into one of
T bins by the round's own hash (for i >= T into bin i - T), an empty bin takes the smallest value of the first round that
reaches it, and rounds go on until every bin is full. So every coordinate is filled, for the shortest documents too, and the
share of equal coordinates estimates the Jaccard similarity with the concentration of independent ones. Bands of coordinates
make the bucket keys: at 0.8, 64 bands of 12, so that a pair at 0.8 misses all of them with a probability of about 1 %, one at
0.85 of 0.01 %, and documents that only share a passage (below 0.5) hardly ever meet. Other similarities have their own bands.

1. Documents with equal shingle sets are one class from the start, whose smallest doc_id stands for it.
2. Stars: in a bucket nobody is paired with everybody. Its leader is the member that shares most bucket places with others,
   the middle of a family of copies of copies, and every document meets the strongest leader of its buckets: one pair each.
   Links make components. Buckets that still hold several components get new leaders outside their largest one, as long as
   such a round links a tenth of its pairs.
3. What is left in mixed buckets is bounded before it is paired: shingles that no other such document has can't be common to
   two, so a document of n shingles with u of them to itself shares n - u at most, and leaves where that can't reach the
   similarity with any size in its bucket. The bound is exact, costs sums per shingle, and is taken twice.
4. Documents of buckets with more than ``LARGE`` pairs left meet by their rarest shingles instead: two at the similarity share one
   of the first n - ceil(n * similarity) + 1 of each, in one order for all, so no pair of such a bucket is lost. A shingle
   that still has more than ``CELL`` pairs is dealt into blocks that meet one another, each pair of blocks on its own.
5. Members outside a bucket's largest component meet its members of other components whose size, bound and low bits of
   the coordinates fit. So links across
   components are looked for in all buckets, and a component's own pairs, the many, are never formed.

Pairs are screened by sketch (four standard deviations below the similarity), then confirmed on the full sets, which are made
once for all documents that share a bucket. Links never leave Spark; components come from rounds of minimum labels and pointer
jumps over written tables.

Null and empty texts have no shingles and are linked with nothing; texts of fewer than k words are one shingle. Rows that
repeat a doc_id are one document. Rows with a null doc_id have no component other than null and are linked with nothing. Ties
between leaders go to the smaller doc_id. A very long text is one chunk of its own, with memory in proportion. An empty table
gives an empty result; extra columns are ignored, or pass through :func:`near_dedup`.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, fresh, mix, text_bytes, windows, with_text, words, written

#: Words in a shingle and similarity in percent, unless a contract says otherwise.
SHINGLE, PERCENT = 5, 80
#: Bins (2**BIN_BITS), the probability of missing all buckets at the similarity, and the rows of a band at most.
BIN_BITS, MISS, MAX_ROWS = 9, 0.0105, 32
BINS = 1 << BIN_BITS
#: Low bits of each coordinate that pairs are compared by before they are formed.
PLANES = 2
#: Rounds of stars at most, and the share of their pairs that must become links for another round.
STARS, PRODUCTIVE = 6, 0.1
#: Pairs of a bucket beyond which its documents meet by shingles, and pairs that are formed for one key at most.
LARGE, CELL = 1 << 16, 1 << 22
#: Texts that are sketched at once, at most: a sketch takes 4 KB while it is made, however short its text.
TEXTS = 1024


def shape(percent: int) -> tuple[int, int]:
    """Bands and rows: as many rows as leave a pair at the similarity 6.8 % for each band, and bands for MISS."""
    if not 1 <= percent <= 100:
        raise ValueError(f"{percent} percent")
    s = percent / 100
    rows = MAX_ROWS if s == 1 else min(MAX_ROWS, max(1, int(math.log(0.068) / math.log(s))))
    return 1 if s == 1 else math.ceil(math.log(MISS) / math.log(1 - s**rows)), rows


def layout(bands: int, rows: int) -> np.ndarray:
    """The coordinates of each band: runs of random orders of all bins, so that a coordinate is in as few bands as can be."""
    draw, each = np.random.default_rng(20240301), BINS // rows
    orders = [draw.permutation(BINS)[: each * rows].reshape(each, rows) for _ in range(-(-bands // each))]
    return np.concatenate(orders)[:bands]


def screen(percent: int) -> int:
    """Pairs whose sketches agree in fewer coordinates are dropped: the similarity less four standard deviations."""
    s = percent / 100
    return int(BINS * max(s - 4 * (s * (1 - s) / BINS) ** 0.5, 0))


def unlike(percent: int) -> int:
    """Pairs that differ in the low PLANES bits of more coordinates are dropped: what is expected plus four standard deviations."""
    d = (1 - percent / 100) * (1 - 0.5**PLANES)
    return math.ceil(BINS * d + 4 * (BINS * d * (1 - d)) ** 0.5)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, A-Z lower-cased."""
    _, _, hashes, off = words(raw, offsets, lower=True)
    grams = windows(hashes, k)
    out = []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:  # the whole sequence, in a space of its own
            out.append(mix(windows(hashes[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BINS coordinates per set; rows of empty sets stay at the largest value."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((len(sets), BINS), empty)
    flat = out.reshape(-1)
    sizes = np.array([len(s) for s in sets], np.int64)
    active = np.flatnonzero(sizes)
    values = np.concatenate([sets[i] for i in active]) if len(active) else np.empty(0, np.uint64)
    base = np.repeat(active * BINS, sizes[active])
    shift = np.uint64(64 - BIN_BITS)
    for i in range(2 * BINS):
        if not len(active):
            break
        y = mix(values + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        at = base + ((y >> shift).astype(np.int64) if i < BINS else i - BINS)
        y <<= np.uint64(BIN_BITS)
        y >>= np.uint64(BIN_BITS + 1)
        np.minimum.at(flat, at, y | np.uint64(i << (63 - BIN_BITS)))
        left = (out[active] == empty).any(1)
        if not left.all():
            keep = np.repeat(left, sizes[active])
            active, values, base = active[left], values[keep], base[keep]
    return out


def band_keys(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The bucket of each set in each band."""
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03), (len(sketches), bands)).copy()
    for at in layout(bands, rows).T:
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + sketches[:, at])
    return keys.astype(np.int64)


def sketch_batch(batch: pa.RecordBatch, k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """The rows of :func:`sketched` for a batch (doc_id, text), of 1 MB of text and TEXTS texts at a time."""
    n_bands, n_rows = shape(percent)
    raw, offsets = text_bytes(batch.column("text"))
    for a, b in chunks(offsets, most=TEXTS):
        sets = shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
        sketches = sketch(sets)
        n = np.array([len(s) for s in sets], np.int64)
        keys = pa.array([hashlib.blake2b(s, digest_size=16).digest() for s in sets], pa.binary())
        bands = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * n_bands, n_bands), pa.int32()), pa.array(band_keys(sketches, n_bands, n_rows).reshape(-1)))
        low = (sketches & np.uint64(0xFF)).astype(np.uint8)
        each, planes = PLANES * BINS // 64, np.concatenate([np.packbits(low >> i & 1, axis=1) for i in range(PLANES)], 1)
        bits = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * each, each), pa.int32()), pa.array(planes.reshape(-1).view(np.int64)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id")[a:b], pa.array(n), keys, bands, pa.array([x.tobytes() for x in low], pa.binary()), bits],
            names=["doc_id", "n_shingles", "set_key", "bands", "sketch", "bits"],
        )


def sketched(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, set_key (of the whole set), bands, sketch (a byte per coordinate), bits (PLANES of each coordinate, plane by plane); written."""
    schema = "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch binary, bits array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from sketch_batch(batch, k, percent)

    return written(with_text(docs).mapInArrow(run, schema))


def _screened(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches agree well enough; ``known``: doc, n_shingles, sketch."""
    least = screen(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("sketch_a", "sketch_b"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= least))

    for side in "ab":
        pairs = pairs.join(known.select(F.col("doc").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}")), side)
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return pairs.filter(fits).select("a", "b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def _sets(ids: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """doc and its shingle set, for the documents in ``ids`` (doc); written. Texts are shuffled once, unsorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column("text"))
            for a, b in chunks(offsets):
                found = shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                at = np.concatenate(([0], np.cumsum([len(x) for x in found])))
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(found).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], lists], names=["doc", "set"])

    texts = with_text(docs).join(ids.hint("shuffle_hash"), F.col("doc_id") == F.col("doc"), "left_semi")
    return written(texts.mapInArrow(run, "doc long, set array<long>"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = np.sort(np.concatenate((x, y)))
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    for side in "ab":
        pairs = pairs.join(sets.select(F.col("doc").alias(side), F.col("set").alias(f"set_{side}")), side)
    return written(pairs.mapInArrow(run, "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node that it reaches) of every node of the edges (a, b), a written table.

    Labels sink to a node's neighbours; from the third round on they also jump to their label's label, so that a chain of n
    edges takes about log n rounds, and the stars that are the rule take two.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")))
    rounds = 0
    while True:
        rounds += 1
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("label", "near").alias("label"), F.col("label").alias("before"))
        if rounds > 2:
            new = written(new)
            jump = new.select(F.col("node").alias("at"), F.col("label").alias("next"))
            new = new.join(jump, F.col("label") == F.col("at")).select("node", F.col("next").alias("label"), "before")
        new = written(new)
        labels = new.select("node", "label")
        if new.filter("label <> before").isEmpty():
            return labels


def _merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The labels after some more edges: components of the components that the edges touch; written."""
    of = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"l{side}"))
    named = edges.join(of("a"), "a", "left").join(of("b"), "b", "left")
    lifted = written(named.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).distinct())
    small = components(lifted).select(F.col("node").alias("at"), F.col("label").alias("next"))
    fresh = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels.select("node"), "node", "left_anti")
    every = labels.unionByName(fresh.select("node", F.col("node").alias("label")))
    return written(every.join(small, F.col("label") == F.col("at"), "left").select("node", F.coalesce("next", "label").alias("label")))


def _pairs(of: DataFrame, a: str, b: str) -> DataFrame:
    return of.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _star(members: DataFrame, led: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs, leaders): each document of ``members`` (bucket, doc) with the strongest leader of its buckets; pairs written.

    ``led``: documents (doc) that led before and don't lead again.
    """
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    weight = members.join(sizes, "bucket").groupBy("doc").agg(F.sum("size").alias("weight"))
    weighted = members.join(weight, "doc")
    able = weighted if led is None else weighted.join(led, "doc", "left_anti")
    lead = written(able.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("doc")).alias("low"))).alias("lead")))
    best = members.join(lead, "bucket").groupBy("doc").agg(F.max("lead").alias("lead")).select("doc", (-F.col("lead.low")).alias("leader"))
    return written(_pairs(best.filter("doc <> leader"), "doc", "leader")), lead.select((-F.col("lead.low")).alias("doc")).distinct()


def _mixed(members: DataFrame) -> DataFrame:
    """The rows (bucket, doc, label, n, ...) of buckets with several components; adds ``minor``: outside the bucket's largest.

    Adds also ``smallest``, the fewest shingles of a member, and ``work``, the pairs that the bucket may have to form.
    """
    counts = members.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("many"), F.min("n").alias("least"))
    top = F.max_by(F.struct("label", "many"), F.struct("many", "label")).alias("top")
    mixed = counts.groupBy("bucket").agg(top, F.count(F.lit(1)).alias("labels"), F.sum("many").alias("all"), F.min("least").alias("smallest"))
    mixed = mixed.filter("labels > 1").select("bucket", "smallest", F.col("top.label").alias("largest"), ((F.col("all") - F.col("top.many")) * F.col("all")).alias("work"))
    return written(members.join(mixed, "bucket").withColumn("minor", F.col("label") != F.col("largest")).drop("largest"))


def _bounded(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``members`` with ``most``, the shingles that a document may share with others, without those that can't have a partner."""
    own = sets.join(members.select("doc").distinct(), "doc", "left_semi").select("doc", F.explode("set").alias("shingle"))
    alone = own.groupBy("shingle").agg(F.min("doc").alias("doc"), F.max("doc").alias("last")).filter("doc = last").groupBy("doc").agg(F.count(F.lit(1)).alias("alone"))
    most = members.join(alone, "doc", "left").withColumn("most", F.col("n") - F.coalesce("alone", F.lit(0))).drop("alone")
    return most.filter((100 + percent) * F.col("most") >= percent * (F.col("n") + F.greatest("smallest", F.ceil(F.col("n") * percent / 100))))


def _first_shingles(large: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``large`` (doc, label, n, most) in a bucket for each shingle that may be the first it shares with one at the similarity.

    The order is one for all, the rarest first. Of n shingles ceil(n * similarity) have to be shared, so the first shared one has
    as many from it on, in both documents.
    """
    # a text of a repeated doc_id counts for itself
    own = sets.join(large.select("doc"), "doc", "left_semi").select("doc", F.monotonically_increasing_id().alias("one"), F.size("set").alias("size"), F.explode("set").alias("bucket"))
    many = own.groupBy("bucket").agg(F.count(F.lit(1)).alias("many"))
    ranked = own.join(many, "bucket").withColumn("rank", F.row_number().over(Window.partitionBy("one").orderBy("many", "bucket")))
    first = ranked.filter((F.col("many") > 1) & (F.col("rank") <= F.col("size") - F.ceil(F.col("size") * percent / 100) + 1))
    return first.select("bucket", "doc").distinct().join(large, "doc")


def _across(members: DataFrame, known: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of different components in the buckets of ``members``; written."""
    rows = members.filter(F.col("work") <= LARGE)
    large = members.filter(F.col("work") > LARGE).select("doc", "label", "n", "most").distinct()
    if not large.isEmpty():
        rows = rows.unionByName(_mixed(_first_shingles(written(large), sets, percent)))
    rows = rows.join(known.select("doc", "bits"), "doc").withColumn("deals", F.ceil(F.sqrt(F.col("work") / CELL)).cast("int"))
    # the row in its own block, once for each block that it meets
    own, other = F.pmod(F.xxhash64("doc"), "deals").cast("int"), F.explode(F.sequence(F.lit(0), F.col("deals") - 1))
    x, y = (
        rows.select("bucket", own.alias(mine), other.alias(met), *(F.col(c).alias(f"{c}_{side}") for c in ("doc", "label", "n", "most", "minor", "bits")))
        for side, mine, met in (("a", "block_a", "block_b"), ("b", "block_b", "block_a"))
    )
    n, most = F.col("n_a") + F.col("n_b"), F.least("most_a", "most_b")
    fits = (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & ((100 + percent) * most >= percent * n)
    differ = lambda i: reduce(Column.bitwiseOR, (F.col("bits_a")[j].bitwiseXOR(F.col("bits_b")[j]) for j in range(i, PLANES * BINS // 64, BINS // 64)))
    fits &= sum((F.bit_count(differ(i)) for i in range(BINS // 64)), F.lit(0)) <= unlike(percent)
    once = ~F.col("minor_b") | (F.col("doc_a") < F.col("doc_b"))
    return written(_pairs(x.filter("minor_a").join(y, ["bucket", "block_a", "block_b"]).filter((F.col("label_a") != F.col("label_b")) & once & fits), "doc_a", "doc_b"))


def _labels(members: DataFrame, ids: DataFrame, own: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """node, label (of its component) of the documents that have links, among ``members`` (bucket, doc) of shared buckets."""
    known = written(own.join(ids, "doc", "left_semi").select("doc", "n_shingles", "sketch", "bits").dropDuplicates(["doc"]))
    sets = _sets(ids, docs, k)

    pairs, led = _star(members)
    labels = components(_confirmed(_screened(pairs, known, percent), sets, percent))
    sized = written(members.join(known.select("doc", F.col("n_shingles").alias("n")), "doc"))
    for _ in range(STARS):
        placed = sized.join(labels, F.col("doc") == F.col("node"), "left").select("bucket", "doc", "n", F.coalesce("label", "doc").alias("label"))
        left = _mixed(placed)
        if left.isEmpty():
            return labels
        pairs, leaders = _star(left.filter("minor").select("bucket", "doc"), led)
        led = written(led.unionByName(leaders).distinct())
        links = _confirmed(_screened(pairs, known, percent), sets, percent)
        n_links = links.count()
        if n_links:
            labels = _merged(labels, links)
        if n_links <= PRODUCTIVE * pairs.count():
            break
    left = left.drop("label").join(labels, F.col("doc") == F.col("node"), "left").select("bucket", "doc", "n", F.coalesce("label", "doc").alias("label"))
    left = _mixed(left)
    for _ in range(2):
        left = _mixed(_bounded(left, sets, percent).drop("minor", "smallest", "work"))
        if left.isEmpty():
            return labels
    links = _confirmed(_screened(_across(left, known, sets, percent), known, percent), sets, percent)
    return labels if links.isEmpty() else _merged(labels, links)


def _moved(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The sketched table, and moved_id, component of the documents that aren't the smallest of theirs; both written."""
    table = sketched(docs, k, percent)
    linked = table.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    same = linked.groupBy("set_key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("set_key", "first")
    # classes of equal sets: their first document stands for all
    copies = written(linked.join(same, "set_key").filter("first <> doc_id").select("doc_id", F.col("first").alias("doc")).distinct())
    own = linked.join(copies.select("doc_id"), "doc_id", "left_anti").select(F.col("doc_id").alias("doc"), "n_shingles", "bands", "sketch", "bits")
    member = own.select("doc", F.explode("bands").alias("bucket"))
    shared = written(member.groupBy("bucket").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high").select("bucket"))
    # own has a row for each repetition of a doc_id; one stands for all of them from here on
    members = written(member.join(shared, "bucket").distinct())
    ids = written(members.select("doc").distinct())
    labels = ids.select(F.col("doc").alias("node"), F.col("doc").alias("label")) if ids.isEmpty() else _labels(members, ids, own, docs, k, percent)
    # the few documents that move: copies go with the one that stands for them
    moved = labels.filter("label <> node").select(F.col("node").alias("moved_id"), F.col("label").alias("component"))
    return table, written(moved.unionByName(copies.join(labels, F.col("doc") == F.col("node"), "left").select(F.col("doc_id").alias("moved_id"), F.coalesce("label", "doc").alias("component"))))


def near_groups(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    table, moved = _moved(docs, k, percent)
    return table.select("doc_id", "n_shingles").join(moved, F.col("doc_id") == F.col("moved_id"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.col("component").isNull().alias("kept")
    )


def near_dedup(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, with all their columns, of one document of each component: the smallest doc_id.

    The dropped ids are the build side of a hash join, so texts are shuffled once at most and never sorted.
    """
    gone, other = _moved(docs, k, percent)[1], fresh("id")
    return docs.join(gone.select(F.col("moved_id").alias(other)).hint("shuffle_hash"), F.col("doc_id") == F.col(other), "left_anti")
