"""Entities of a catalog table in texts: cashtags, symbols and aliases by equi-join (STR1-5, JN22).

The catalog may have any size, for nothing of it but a filter of bits stands in the plan or in one task. Every entry becomes
keys: its symbol, and for each name or alias the run of its first ``WORDS`` words with what is between them. A text has such
runs too; those that the filter passes stay. A block of texts holds each of its keys once, by number, and only these, not
the texts, meet the catalog by equality; what meets comes back to the block, once for each block, and is told to its texts.
An alias that is its key stands in the text then, for a run begins and ends where words do. Others (more words, or other
characters at an end) are candidates: they go back to their text and are looked for as a whole, between characters that
aren't of a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..functions import text as T
from ..sources.storage import written
from .ranges import numbered

#: Words of a key at most.
WORDS = 3
#: Texts and bytes of a block, bytes that are hashed at once; a longer text is a block of its own.
TEXTS, BLOCK, PIECE = 4096, 1 << 24, 1 << 18
#: Bits of the filter for each alias, and at most (2**MAX_BITS). A fuller filter passes more, never less.
BITS, MAX_BITS = 64, 26
#: A key has a bit for each of these.
_PROBES = tuple(np.uint64(x) for x in (0x1, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))
_BASE = 0x9E3779B97F4A7C15


def _key(alias: Column) -> Column:
    """What an alias is found by: its first words and what is between them. Aliases without a word meet every text."""
    return F.regexp_extract(alias, rf"(?U)\w++(?:\W++\w++){{0,{WORDS - 1}}}", 0)


def lookup(catalog: DataFrame, ambiguous: tuple[str, ...] = lex.AMBIGUOUS_SYMBOLS) -> DataFrame:
    """key, kind (0 symbol, 2 alias), place, alias, ticker, company_name, from ticker, company_name, aliases, line.

    Names and aliases (split at |) are lower-cased and trimmed; of equal ones the last line's ticker counts, in the place of the
    first. ``line`` orders the catalog; of equal tickers its last line counts, in the place of the first. Aliases are cut where
    they are blank; symbols that are ``ambiguous`` are found by their aliases only, as are those that no text can show.
    """
    rows = catalog.withColumn("ticker", F.upper(F.trim("ticker"))).filter("ticker <> ''")
    fields = F.struct(F.trim(F.coalesce("company_name", F.lit(""))).alias("company_name"), F.coalesce("aliases", F.lit("")).alias("aliases"))
    one = written(rows.groupBy("ticker").agg(F.min("line").alias("line"), F.max_by(fields, "line").alias("r")).select("ticker", "line", "r.*"))
    names = F.concat(F.array("company_name"), F.split("aliases", r"\|"))
    each = one.select("ticker", "company_name", "line", F.posexplode(names).alias("n", "alias")).withColumn("alias", F.lower(F.trim("alias"))).filter("alias <> ''")
    at = F.struct("line", "n")
    aliases = each.groupBy("alias").agg(F.min(at).alias("at"), F.max_by(F.struct("ticker", "company_name"), at).alias("r"))
    aliases = numbered(aliases.select("alias", F.col("at.line").alias("line"), F.col("at.n").alias("n"), "r.*"), [], ["line", "n"], "place")
    found = aliases.select(_key(F.col("alias")).alias("key"), F.lit(2).alias("kind"), "place", "alias", "ticker", "company_name")
    symbol = one.filter(~F.col("ticker").isin(*ambiguous) & F.col("ticker").rlike(r"^[A-Z]{1,5}\z"))
    # aliases are lower-cased, symbols aren't: no key is of both kinds
    return found.unionByName(symbol.select(F.col("ticker").alias("key"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("place"), F.lit(None).cast("string").alias("alias"), "ticker", "company_name"))


def _bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and the n + 1 offsets into them."""
    _, offsets, data = strings.buffers()
    if not len(strings):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), np.frombuffer(offsets, np.int32, len(strings) + 1, strings.offset * 4).astype(np.int64)


def _hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every run of bytes [start, end): differences of running sums of a polynomial, mixed."""
    power, back = (np.full(len(raw) + 1, x & 0xFFFFFFFFFFFFFFFF, np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
    power[0] = back[0] = 1
    np.multiply.accumulate(power, out=power)
    np.multiply.accumulate(back, out=back)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
    h = (total[ends] - total[starts]) * back[starts]
    for _ in range(2):
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _filter(keys: DataFrame) -> np.ndarray:
    """The bits of every ``key``, in an array of a power of two of 64-bit words."""
    size = min(max(6, (BITS * keys.count()).bit_length()), MAX_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = _bytes(batch.column("key"))
            h = _hashes(raw[offsets[0] : offsets[-1]], offsets[:-1] - offsets[0], offsets[1:] - offsets[0])
            bit = np.concatenate([h * x for x in _PROBES]) >> np.uint64(64 - size)
            yield pa.RecordBatch.from_arrays([pa.array((bit >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (bit & np.uint64(63))).view(np.int64))], names=["word", "bits"])

    rows = keys.select("key").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # 2**(MAX_BITS - 6) at most
    out = np.zeros(1 << (size - 6), np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def _runs(tokens: pa.ListArray, passed: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The runs of up to WORDS words (none as well) that the filter passes: number of their text, and the runs.

    ``tokens``: the words of each text and, between them, what is between them.
    """
    off = tokens.offsets.to_numpy().astype(np.int64)
    raw, at = _bytes(tokens.values)
    raw, at = raw[at[off[0]] : at[off[-1]]], at - at[off[0]]
    many = (np.diff(off) + 1) // 2
    text = np.repeat(np.arange(len(many)), many)
    word = off[text] + 2 * (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many))
    texts, starts, ends = [np.arange(len(many))], [np.zeros(len(many), np.int64)], [np.zeros(len(many), np.int64)]
    for last in range(0, 2 * WORDS, 2):
        whole = word + last < off[text + 1]
        texts.append(text[whole])
        starts.append(at[word[whole]])
        ends.append(at[word[whole] + last + 1])
    text, start, end = np.concatenate(texts), np.concatenate(starts), np.concatenate(ends)
    h, hit = _hashes(raw, start, end), np.arange(len(text))
    for x in _PROBES:
        bit = h[hit] * x >> np.uint64(65 - (len(passed) * 64).bit_length())
        hit = hit[(passed[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)]
    text, start, size = text[hit], start[hit], (end - start)[hit]
    to = np.concatenate(([0], np.cumsum(size)))
    data = raw[np.repeat(start - to[:-1], size) + np.arange(to[-1])]
    return text, pa.StringArray.from_buffers(len(hit), pa.py_buffer(to.astype(np.int32)), pa.py_buffer(data))


def _lists(row: np.ndarray, values: pa.Array, n: int) -> pa.ListArray:
    """Lists of the values of n rows; ``row`` ascends."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()), values)


def _pieces(tokens: pa.ListArray, size: int, most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts [a, b) of about ``size`` bytes and at most ``most`` texts."""
    at = _bytes(tokens.values)[1][tokens.offsets.to_numpy()]
    a = 0
    while a < len(tokens):
        b = min(max(a + 1, int(np.searchsorted(at, at[a] + size, "right")) - 1), a + most, len(tokens))
        yield a, b
        a = b


def _cut(items: DataFrame, passed: np.ndarray, item: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Texts (block, item, symbols, names: numbers of keys, symbols in order of appearance) and keys (block, number, key) of blocks."""
    body = T.empty_if_null(F.col(text))
    tokens = F.regexp_extract_all(F.lower(body), F.lit(r"(?U)\w+|(?<=\w)\W+"), F.lit(0))
    symbols = F.array_distinct(F.concat(T.cashtags(body), T.bare_symbols(body)))
    shared = items.sparkSession.sparkContext.broadcast(passed)

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, tokens = batch.num_rows, batch.column("tokens")
        found = [(a, *_runs(tokens.slice(a, b - a), shared.value)) for a, b in _pieces(tokens, PIECE, n)]
        of = batch.column("symbols")
        texts = [np.repeat(np.arange(n), np.diff(of.offsets.to_numpy())), *(a + at for a, at, _ in found)]
        coded = pa.concat_arrays([of.flatten(), *(keys for _, _, keys in found)]).dictionary_encode()
        number, n_symbols = coded.indices.to_numpy(), len(texts[0])
        names = np.unique(np.concatenate(texts[1:]).astype(np.int64) << 32 | number[n_symbols:])
        none = pa.nulls(1, pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n + 1, batch.column("at")[0].as_py())), pa.concat_arrays([batch.column("item"), pa.nulls(1, batch.column("item").type)]),
                pa.concat_arrays([_lists(texts[0], pa.array(number[:n_symbols], pa.int32()), n), none]),
                pa.concat_arrays([_lists(names >> 32, pa.array(names & 0xFFFFFFFF, pa.int32()), n), none]),
                pa.concat_arrays([pa.nulls(n, pa.list_(pa.string())), pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)]),
            ], names=["block", "item", "symbols", "names", "keys"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _pieces(batch.column("tokens"), BLOCK, TEXTS):
                yield block(batch.slice(a, b - a))

    kind = dict(items.dtypes)[item]
    rows = items.select(F.monotonically_increasing_id().alias("at"), F.col(item).alias("item"), symbols.alias("symbols"), tokens.alias("tokens"))
    rows = written(rows.mapInArrow(run, f"block long, item {kind}, symbols array<int>, names array<int>, keys array<string>"))
    return rows.filter("keys IS NULL").drop("keys"), rows.filter("keys IS NOT NULL").select("block", F.posexplode("keys").alias("number", "key"))


def _told(texts: pa.Table, known: pa.Table) -> pa.Table:
    """item, tickers, company_names of a block's texts, from what its keys met."""
    texts, known, n = texts.combine_chunks(), known.combine_chunks(), texts.num_rows
    column = lambda t, c: t[c].combine_chunks() if isinstance(t[c], pa.ChunkedArray) else t[c]
    flat = lambda c: (np.repeat(np.arange(n), column(texts, c).value_lengths().fill_null(0).to_numpy()), column(texts, c).flatten().to_numpy(zero_copy_only=False))
    number, place = known["number"].to_numpy(), known["place"].to_numpy()
    sure = np.flatnonzero(column(known, "alias").is_null().to_numpy(zero_copy_only=False))
    by_place = np.argsort(place, kind="stable")
    (i, symbols), (j, names), (k, stands) = flat("symbols"), flat("names"), flat("stands")
    at = np.full(max((int(x.max()) for x in (number, symbols, names) if len(x)), default=0) + 1, -1)
    at[number[sure]] = sure
    rest = by_place[np.searchsorted(place, stands, sorter=by_place)] if len(stands) else np.empty(0, np.int64)
    row, text = np.concatenate((at[symbols], at[names], rest)).astype(np.int64), np.concatenate((i, j, k))
    order = np.concatenate((np.arange(len(symbols)) - len(symbols), place[row[len(symbols) :]] if len(place) else np.zeros(len(row) - len(symbols), np.int64)))
    met = np.flatnonzero(row >= 0)
    met = met[np.lexsort((order[met], text[met]))]
    row, text = row[met], text[met]
    tickers = column(known, "ticker").dictionary_encode()
    pair = text * (len(tickers.dictionary) + 1) + tickers.indices.to_numpy()[row] if len(row) else text
    first = np.sort(np.unique(pair, return_index=True)[1])
    row, text = pa.array(row[first]), text[first]
    return pa.table({"item": texts["item"], **{f"{c}s": _lists(text, column(known, c).take(row), n) for c in ("ticker", "company_name")}})


def _standing(texts: DataFrame, met: DataFrame, items: DataFrame, item: str, text: str) -> DataFrame:
    """item, stands: the places of those aliases which aren't keys that stand in its text."""
    quoted = F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.replace("alias", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?!\w)"))
    pairs = texts.select("block", "item", F.explode("names").alias("number")).join(met.filter("alias IS NOT NULL").select("block", "number", "place", "alias"), ["block", "number"])
    bodies = items.select(F.col(item).alias("item"), F.lower(T.empty_if_null(F.col(text))).alias("low"))
    return pairs.join(bodies, "item").filter(F.contains("low", "alias") & F.regexp("low", quoted)).groupBy("item").agg(F.collect_list("place").alias("stands"))


def found(items: DataFrame, catalog: DataFrame, item: str = "item_id", text: str = "body_text", ambiguous: tuple[str, ...] = lex.AMBIGUOUS_SYMBOLS) -> DataFrame:
    """The id of each item with ``tickers`` and ``company_names``, as in :func:`entities`; no text is shuffled for aliases that are keys."""
    name = F.coalesce(F.nullif("company_name", F.lit("")), F.lit("Unknown"))
    known = written(lookup(catalog, ambiguous).withColumns({"company_name": name, "alias": F.nullif("alias", "key")}))
    texts, keys = _cut(items, _filter(known.filter("kind = 2")), item, text)
    met = keys.join(known.drop("kind"), "key").drop("key")
    if known.filter("alias IS NOT NULL").isEmpty():
        texts = texts.withColumn("stands", F.array().cast("array<long>"))
    else:
        met = written(met)
        texts = texts.join(_standing(texts, met, items, item, text), "item", "left")
    schema = f"item {dict(items.dtypes)[item]}, tickers array<string>, company_names array<string>"
    met = met.withColumn("of", F.col("block")).drop("block")
    return texts.groupBy("block").cogroup(met.groupBy("of")).applyInArrow(_told, schema).withColumnRenamed("item", item)


def entities(items: DataFrame, catalog: DataFrame, item: str = "item_id", text: str = "body_text", ambiguous: tuple[str, ...] = lex.AMBIGUOUS_SYMBOLS) -> DataFrame:
    """Each item with ``tickers`` and, beside them, ``company_names`` (Unknown where blank).

    Cashtags come first, then symbols, each in order of appearance, then aliases in the order of the catalog; a ticker comes once.
    Items have an id each; null texts have no tickers.
    """
    told = found(items, catalog, item, text, ambiguous).withColumnRenamed(item, "_item")
    none = F.array().cast("array<string>")
    return items.join(told, F.col(item) == F.col("_item"), "left").withColumns({c: F.coalesce(c, none) for c in ("tickers", "company_names")}).drop("_item")
