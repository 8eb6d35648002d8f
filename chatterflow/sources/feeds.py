"""Landed feed files, catalogs and seeds (SRC1-SRC13, SRC20-21). Fetching stays outside: an adapter lands files, Spark reads them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import conform_items

ENTRY = (
    "id string, author struct<name:string>, content struct<_VALUE:string,_type:string>, link struct<_href:string>, published string, updated string, title string"
)


def atom_entries(spark: SparkSession, path: str) -> DataFrame:
    """SRC5, SRC7: Atom entries of landed XML files as items. The score isn't in feeds and is 0."""
    raw = spark.read.schema(ENTRY).option("rowTag", "entry").option("ignoreNamespace", "true").xml(path)
    kind = F.substring("id", 1, 3)
    item = F.regexp_replace("id", "^t[13]_", "")
    link = F.col("link._href")
    thread = T.thread_id(link)
    comment = kind == "t1_"
    title = F.when(comment & F.col("title").contains(" on "), F.regexp_extract("title", "^.*? on (.*)$", 1)).otherwise(F.col("title"))
    out = raw.select(
        "id", F.col("id").alias("item_id"), thread.alias("thread_id"), title.alias("thread_title"), T.community(link).alias("subreddit"), link.alias("permalink"),
        F.when(comment, item).alias("comment_id"), F.when(comment, "comment").otherwise("post").alias("item_type"), T.html_to_text(F.coalesce("content._VALUE", F.lit(""))).alias("body_text"),
        T.author(F.col("author.name")).alias("author"), T.author_hash(T.author(F.col("author.name"))).alias("author_hash"), F.lit(0).alias("score"),
        F.coalesce(F.try_to_timestamp("published"), F.try_to_timestamp("updated")).alias("created_time"), F.when(comment, 1).otherwise(0).alias("comment_depth"),
    )
    return conform_items(out)


def collect(items: DataFrame, start: str, end: str, per_source: int = 0, per_thread: int = 0) -> DataFrame:
    """SRC1-4, SRC9: items in the window, the first of equal ids (thread sources go first), newest up to the caps; 0: no cap.

    The caps are the feature: they stand for what one request shows. Where items have a ``feed_position``, a source's posts are read
    up to the first one that is older than the window, as a feed is (SRC2).
    """
    if "feed_position" in items.columns:
        old = items.filter((F.col("item_type") == "post") & (F.col("created_time") < F.lit(start).cast("timestamp")))
        stop = old.groupBy("source_name").agg(F.min("feed_position").alias("_stop"))  # a row for each source
        seen = F.col("_stop").isNull() | (F.col("item_type") != "post") | (F.col("feed_position") < F.col("_stop"))
        items = items.join(stop, "source_name", "left").filter(seen).drop("_stop")
    inside = items.filter((F.col("created_time") >= F.lit(start).cast("timestamp")) & (F.col("created_time") <= F.lit(end).cast("timestamp")))
    thread_first = F.when(F.col("source_type") == "thread_url", 0).otherwise(1)
    once = inside.withColumn("_n", F.row_number().over(Window.partitionBy("item_id").orderBy(thread_first, "source_name", F.desc("created_time")))).filter("_n = 1").drop("_n")
    for cap, kind, key in ((per_source, "post", "source_name"), (per_thread, "comment", "thread_id")):
        if cap:
            rank = F.row_number().over(Window.partitionBy("item_type", key).orderBy(F.desc("created_time"), "item_id"))
            once = once.withColumn("_n", rank).filter((F.col("item_type") != kind) | (F.col("_n") <= cap)).drop("_n")
    return once


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """SRC11: ticker, company_name, aliases of a CSV; of equal tickers the last row wins."""
    rows = spark.read.schema("ticker string, company_name string, aliases string").option("header", True).csv(path)
    rows = rows.withColumn("ticker", F.upper(F.trim("ticker"))).filter("ticker <> ''").withColumn("_i", F.monotonically_increasing_id())
    best = rows.groupBy("ticker").agg(F.max_by(F.struct("company_name", "aliases"), "_i").alias("r"))
    return best.select("ticker", F.trim("r.company_name").alias("company_name"), F.filter(F.transform(F.split(F.coalesce("r.aliases", F.lit("")), r"\|"), lambda a: F.lower(F.trim(a))), lambda a: a != "").alias("aliases"))


def duplicate_aliases(catalog_: DataFrame) -> DataFrame:
    """AGG20."""
    return catalog_.select(F.explode("aliases").alias("alias"), "ticker").groupBy("alias").agg(F.countDistinct("ticker").alias("tickers")).filter("tickers > 1")


def universe(catalog_: DataFrame) -> DataFrame:
    """SRC12: distinct market symbols."""
    return catalog_.select(T.market_symbol(F.col("ticker")).alias("ticker")).distinct()


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """SRC13."""
    return spark.read.option("multiLine", True).json(path)


def matched_source(items: DataFrame, sources: DataFrame) -> DataFrame:
    """SRC10: a thread source wins over a community source."""
    by_thread = sources.filter("source_type = 'thread_url'").select(F.col("normalized_value").alias("thread_id"), F.col("source_id").alias("_t"))
    by_name = sources.filter("source_type = 'subreddit'").select(F.col("normalized_value").alias("subreddit"), F.col("source_id").alias("_s"))
    return items.join(by_thread, "thread_id", "left").join(by_name, "subreddit", "left").withColumn("source_id", F.coalesce("_t", "_s")).drop("_t", "_s")


def artifacts(spark: SparkSession, path: str) -> DataFrame:
    """SRC21: files below a folder with size and time, without their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.round(F.col("length") / 1024, 1).alias("kb"), F.col("modificationTime").alias("modified"))
