"""URL filters: host and path rules, then a list of canonical URLs behind a blocked Bloom filter.

A listed entry is a ``host/path``; it covers its host's subdomains and the paths below it. The list is brought to the same
canonical form as pages: hosts in lower case without user, port and final dots, paths as below, a host alone with its slash.
A path without a final slash covers itself and what is below it. A page is looked up by every (host suffix, path prefix) key. The keys' hashes go through a blocked Bloom filter (one 512-bit block per key, one bit
in each of its eight words), built by Spark as a bitwise OR per block and no larger than ``MAX_BLOCKS``; only possible hits
leave that map stage, and an exact hash join with the list removes the false positives. However full the filter gets, it
never loses a hit.

Hosts are compared without user, port and final dots, paths with percent signs decoded and dot segments resolved, for listed keys
as for pages. Null urls and urls without ``://`` have empty host and path, fit no rule and aren't listed: they are allowed. Of rules
of one length that fit, the later in order wins, and there are none that both fit. Repeated pages are judged each. Very long urls only have more host suffixes and path prefixes, which are looked up from the shortest
to the longest listed host and down to the deepest listed folder. Null entries and entries without a host cover nothing. An empty table or list gives an empty result or no hits. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: (verdict, rule) in the form that they are given in: host, then path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Sites listed by default.
LISTED = ("ads-track.example.com/", "casino-win.example.com/", "cheap-pills.example.com/", "free-bets.example.com/")
#: Bits for each listed key, and the largest filter: 2**20 blocks of 64 bytes.
BITS_PER_KEY, MAX_BLOCKS = 16, 1 << 20
#: What tells pages apart.
PAGE = ("page_id", "host", "path")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at, slash, below = rule.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(slash + below)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def canonical_host(host: Column) -> Column:
    """Without user, port and final dots."""
    return F.regexp_replace(host, r"^.*@|(:\d*)?\.*$|\.*:\d*$", "")


def canonical_path(path: Column) -> Column:
    """Percent signs decoded, but for those of ``/ ? # %``, and without empty, ``.`` and ``..`` folders."""
    bare = F.regexp_replace(F.regexp_replace(path, "(?i)%(2F|3F|23|25)", "%25$1"), r"\+", "%2B")
    decoded = F.when(path.contains("%"), F.coalesce(F.try_url_decode(bare), path)).otherwise(path)
    folders = F.aggregate(
        F.split(decoded, "/"), F.array().cast("array<string>"),
        lambda kept, x: F.when(x.isin("", "."), kept).when(x == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.array_append(kept, x)),
    )
    tail = F.when(decoded.rlike(r"/\.{0,2}\z") & (F.size(folders) > 0), "/").otherwise("")
    return F.when(decoded.rlike(r"//|/\.{1,2}(/|\z)"), F.concat(F.lit("/"), F.array_join(folders, "/"), tail)).otherwise(decoded)


def canonical_list(listed: DataFrame) -> DataFrame:
    """The distinct keys of a list: canonical host and path; a path without a final slash also as a folder."""
    bare = F.regexp_replace("key", r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    at = F.instr(bare, "/")
    parts = listed.select(F.when(at > 0, F.left(bare, at - 1)).otherwise(bare).alias("host"), F.when(at > 0, F.substr(bare, at)).otherwise("/").alias("path"))
    parts = parts.select(canonical_host(F.translate("host", _UPPER, _LOWER)).alias("host"), canonical_path(F.col("path")).alias("path")).filter("host <> ''")
    both = F.when(F.col("path").endswith("/"), F.array("path")).otherwise(F.array("path", F.concat("path", F.lit("/"))))
    return parts.select("host", F.explode(both).alias("path")).select(F.concat("host", "path").alias("key")).distinct()


def depths(listed: DataFrame) -> tuple[int, int, int]:
    """The fewest and the most labels and the most folders (the root is one) of the listed keys."""
    labels, folders = F.size(F.split(F.substring_index("key", "/", 1), r"\.")), F.size(F.split("key", "/")) - 1
    return tuple(max(n or 0, 1) for n in listed.agg(F.min(labels), F.max(labels), F.max(folders)).first())


def keys(host: Column, path: Column, least: int, n_labels: int, n_folders: int) -> Column:
    """All listed forms that would cover this page: host suffixes of ``least`` labels and more, with path prefixes, up to these depths."""
    labels = F.split(canonical_host(host), r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(least), F.greatest(F.lit(least), F.least(F.size(labels), F.lit(n_labels)))),
        lambda n: F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - n + 1), n), "."),
    )
    path = canonical_path(path)
    folders = F.split(path, "/")
    prefixes = F.array_union(
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size(folders) - 1, F.lit(n_folders)))),
            lambda n: F.concat(F.array_join(F.slice(folders, 1, n), "/"), F.lit("/")),
        ),
        F.array(F.when(path == "", F.lit("/")).otherwise(path)),
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p)))))
    )


def _bits(hashes: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each hash, and its bit in each of the block's eight words."""
    h = hashes.astype(np.uint64)
    block = ((h >> np.uint64(32)) & np.uint64(n_blocks - 1)).astype(np.int64)
    salts = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint64)
    bit = (((h & np.uint64(0xFFFFFFFF))[:, None] * salts) & np.uint64(0xFFFFFFFF)) >> np.uint64(26)
    return block, bit


def bloom(listed: DataFrame) -> np.ndarray:
    """The filter as an array (blocks, 8) of a power of two of blocks, from a table with column ``key``."""
    n_keys = listed.count()
    n_blocks = 1
    while n_blocks < MAX_BLOCKS and n_blocks * 512 < n_keys * BITS_PER_KEY:
        n_blocks *= 2
    names = [f"w{i}" for i in range(8)]

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, bit = _bits(batch.column("hash").to_numpy(), n_blocks)
            ones = (np.uint64(1) << bit).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(block), *(pa.array(ones[:, i]) for i in range(8))], names=["block", *names])

    parts = listed.select(F.xxhash64("key").alias("hash")).mapInArrow(words, "block long, " + ", ".join(f"{n} long" for n in names))
    rows = parts.groupBy("block").agg(*(F.bit_or(n).alias(n) for n in names)).toPandas()  # MAX_BLOCKS rows at most
    out = np.zeros((n_blocks, 8), np.uint64)
    out[rows["block"].to_numpy(np.int64)] = rows[names].to_numpy(np.int64).astype(np.uint64)
    return out


def possible_hits(pages: DataFrame, filter_: np.ndarray) -> DataFrame:
    """PAGE and key of every key of ``pages`` (PAGE, keys, hashes) that the filter passes."""
    shared = pages.sparkSession.sparkContext.broadcast(filter_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            hashes = batch.column("hashes")
            n = hashes.value_lengths().fill_null(0).to_numpy()
            block, bit = _bits(hashes.flatten().to_numpy(), len(table))
            hit = np.flatnonzero(((table[block] >> bit) & np.uint64(1)).all(1))
            page = np.repeat(np.arange(len(n)), n)[hit]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(page)) for c in PAGE), batch.column("keys").flatten().take(pa.array(hit))], names=[*PAGE, "key"])

    kinds = dict(pages.dtypes)
    return pages.select(*PAGE, "keys", "hashes").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in PAGE) + ", key string")


def judge(pages: DataFrame, listed: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, and whether the page is listed."""
    spark = pages.sparkSession
    if listed is None:
        listed = spark.createDataFrame([(x,) for x in LISTED], "key string")
    listed = written(canonical_list(listed.filter("key is not null").select("key")))
    base = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    base = base.withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    open_ = base.filter(F.col("best").isNull()).withColumn("keys", keys(F.col("host"), F.col("path"), *depths(listed)))
    hits = possible_hits(open_.withColumn("hashes", F.transform("keys", lambda k: F.xxhash64(k))), bloom(listed))
    # repeated pages share their verdict; both joins are exact
    same = [F.col(c).eqNullSafe(F.col(f"found_{c}")) for c in PAGE]
    found = hits.join(listed, "key", "left_semi").select(*(F.col(c).alias(f"found_{c}") for c in PAGE)).distinct().withColumn("listed", F.lit(True))
    return base.join(found, same, "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.coalesce(F.col("listed"), F.lit(False)).alias("listed"),
    )
