"""Daily bars, as-of and range joins, and outcomes (JN12-16, WIN8-14, ST11-12, SRC16-17, DF9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..sources.storage import written
from .ranges import running


def daily_bars(ticks: DataFrame, ticker: Column, ts: Column, value: Column, tie: Column) -> DataFrame:
    """Bars per ticker and day: first, highest, lowest, last value, and their number; ``tie`` orders equal times."""
    t = ticks.select(ticker.alias("ticker"), ts.cast("date").alias("date"), value.alias("v"), F.struct(ts.alias("ts"), tie.alias("tie")).alias("o"))
    return t.groupBy("ticker", "date").agg(
        F.min_by("v", "o").alias("open"), F.max("v").alias("high"), F.min("v").alias("low"), F.max_by("v", "o").alias("close"), F.count(F.lit(1)).cast("double").alias("volume")
    )


def prepared(prices: DataFrame) -> DataFrame:
    """ST12: available rows with reference_close, the adjusted close where there is one."""
    available = prices.filter("price_available") if "price_available" in prices.columns else prices
    return available.withColumn("reference_close", F.coalesce("adjusted_close", "close") if "adjusted_close" in prices.columns else F.col("close"))


def by_row() -> Window:
    return Window.partitionBy("ticker").orderBy("date")


def with_outcomes(prices: DataFrame, horizons: dict[str, int] = lex.ROW_HORIZONS) -> DataFrame:
    """WIN8-14: what a buyer at each bar's close would see, by rows ahead. One window over (ticker, date) serves all columns.

    A horizon is null in every measure where its row is absent.
    """
    w = by_row()
    close, volume = F.col("reference_close"), F.col("volume")
    base = prepared(prices).withColumns({"_ret": F.try_divide(close, F.lag(close).over(w)) - 1, "_n": F.row_number().over(w)})
    columns = {
        "next_date": F.lead("date", 1).over(w), "raw_return_same_day": F.round(F.try_divide(close, F.col("open")) - 1, 6),
        "prior_return_5d": F.round(F.try_divide(close, F.when(F.col("_n") > 5, F.lag(close, 5).over(w)).otherwise(F.first(close).over(w.rowsBetween(Window.unboundedPreceding, 0)))) - 1, 6),
        "prior_volatility_10d": F.round(F.stddev_samp("_ret").over(w.rowsBetween(-9, 0)), 6), "gap_return_1d": F.round(F.try_divide(F.lead("open", 1).over(w), close) - 1, 6),
        "baseline_volume": F.round(F.avg(volume).over(w.rowsBetween(-20, -1)), 6),
    }
    for name, k in horizons.items():
        ahead = F.lead(close, k).over(w)
        there = lambda x, a=ahead: F.when(a.isNotNull() & (close != 0), x)
        columns[f"raw_return_{name}"] = there(F.round(F.try_divide(ahead, close) - 1, 6))
        columns[f"absolute_return_{name}"] = F.abs(columns[f"raw_return_{name}"])
        columns[f"price_direction_{name}"] = there(F.when(ahead > close, 1).otherwise(0))
        columns[f"volume_change_{name}"] = there(F.round(F.try_divide(F.lead(volume, k).over(w), volume) - 1, 6))
        columns[f"volatility_{name}"] = there(F.round(F.stddev_samp("_ret").over(w.rowsBetween(1, k)), 6)) if k > 1 else F.lit(None).cast("double")
        columns[f"drawdown_{name}"] = there(F.round(F.try_divide(F.min(close).over(w.rowsBetween(0, k)), close) - 1, 6))
    return base.withColumns(columns).drop("_ret", "_n")


def asof_forward(events: DataFrame, prices: DataFrame, day: str, keep: list[str]) -> DataFrame:
    """JN12: each event with the first bar of its ticker on or after its day, or nulls; a null day has none.

    Events and bars in one order, latest first and bars before events, in which each event takes the last bar seen. Ranges of
    that order carry their last bar into the next one, so a ticker's or a day's events are spread over many tasks.
    """
    bars = prices.select("ticker", F.col("date").alias("_day"), F.lit(1).alias("_bar"), F.struct("date", *keep).alias("_p"))
    apart = [F.col(f.name) for f in events.schema if f.dataType.typeName() not in ("map", "variant")]
    rows = events.withColumns({"_day": F.col(day), "_bar": F.lit(0), "_h": F.xxhash64(*apart)})
    both = rows.unionByName(bars, allowMissingColumns=True)
    found = running(both, ["ticker"], [F.desc("_day"), F.desc("_bar"), "_h"], {"_p": ("last", "_p")}).filter("_bar = 0")
    bar = F.when(F.col("_day").isNotNull(), F.col("_p"))
    return found.select(*events.columns, bar.getField("date").alias("price_date"), *(bar.getField(k).alias(k) for k in keep))


def _days(events: DataFrame, day: str) -> DataFrame:
    """Each ticker's days once: outcomes depend on nothing else, however many events share them."""
    return events.select("ticker", day).filter(F.col(day).isNotNull()).distinct()


def _steps(days: DataFrame, prices: DataFrame, day: str, close: str, horizons: tuple[int, ...], more: tuple[str, ...] = ()) -> DataFrame:
    """By ticker and day: c0, the close as of the day, and c_h as of h days later; ``more`` columns of the first bar."""
    steps = days.withColumn("h", F.explode(F.array(F.lit(0), *map(F.lit, horizons)))).withColumn("at", F.date_add(day, F.col("h")))
    met = asof_forward(steps, prices, "at", [close, *more])
    of = lambda h, c: F.max(F.when(F.col("h") == h, F.col(c)))
    return met.groupBy("ticker", day).agg(*(of(h, close).alias(f"c{h}") for h in (0, *horizons)), *(of(0, c).alias(c) for c in more))


def calendar_returns(events: DataFrame, prices: DataFrame, key: str, day: str, horizons=lex.DAY_HORIZONS) -> DataFrame:
    """JN13: return from the bar on or after the day to the bar on or after so many days later, one column per horizon."""
    found = _steps(_days(events, day), prices, day, "close", tuple(horizons))
    returns = found.select("ticker", day, *(F.round(F.try_divide(F.col(f"c{h}"), F.col("c0")) - 1, 6).alias(f"return_{h}d") for h in horizons))
    return events.select(key, "ticker", day).join(returns, ["ticker", day], "left").select(key, "ticker", day, *(f"return_{h}d" for h in horizons))


def _paths(days: DataFrame, prices: DataFrame, day: str, windows: tuple[int, ...], close: str = "close") -> DataFrame:
    """By ticker and day: best and worst close within [day, day + n], largest and mean volume within (day, day + n].

    The range is cut into blocks of its own length, which join by equality: a block of a ticker has as many days and bars at most.
    """
    longest = max(windows)
    block = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / longest)
    e = days.withColumn("_b", F.explode(F.array(block(F.col(day)), block(F.col(day)) + 1)))
    p = prices.select("ticker", "date", F.col(close).alias("_close"), "volume").withColumn("_b", block(F.col("date")))
    ahead = F.datediff("date", day)
    met = e.join(p, ["ticker", "_b"]).filter(ahead.between(0, longest))
    aggs = []
    for n in windows:
        within, after = ahead <= n, ahead.between(1, n)
        aggs += [F.max(F.when(within, F.col("_close"))).alias(f"max_close_{n}d"), F.min(F.when(within, F.col("_close"))).alias(f"min_close_{n}d")]
        aggs += [F.max(F.when(after, F.col("volume"))).alias(f"max_volume_{n}d"), F.avg(F.when(after, F.col("volume"))).alias(f"mean_volume_{n}d")]
    return met.groupBy("ticker", day).agg(*aggs)


def path_metrics(events: DataFrame, prices: DataFrame, key: str, day: str, windows=(7, 14, 30)) -> DataFrame:
    """JN15, JN16: best and worst close and largest and mean volume after each event; one range join at the longest window."""
    found = _paths(_days(events, day), prices, day, tuple(windows)).withColumns({f"mean_volume_{n}d": F.round(f"mean_volume_{n}d", 4) for n in windows})
    measures = [f"{m}_{n}d" for n in windows for m in ("max_close", "min_close", "max_volume", "mean_volume")]
    return events.select(key, "ticker", day).join(found, ["ticker", day], "left").select(key, "ticker", day, *measures)


def day_outcomes(days: DataFrame, prices: DataFrame, day: str, returns: tuple[int, ...], paths: tuple[int, ...], spikes: tuple[int, ...], abnormal: tuple[int, ...] = ()) -> DataFrame:
    """By ticker and day, from the adjusted closes: the price on or after the day, returns, best gain and worst drawdown, and
    the largest (spike) and mean (abnormal) volume after the day, each over the mean of the 20 bars before the first one.

    Ratios have four digits; they are null where what they divide by is absent or 0.
    """
    bars = prepared(prices).withColumn("_baseline", F.avg("volume").over(by_row().rowsBetween(-20, -1)))
    first = _steps(days, bars, day, "reference_close", returns, ("_baseline",))
    found = first.join(_paths(days, bars, day, tuple(sorted({*paths, *spikes, *abnormal})), "reference_close"), ["ticker", day], "left")
    change = lambda c: F.round(F.try_divide(F.col(c), F.col("c0")) - 1, 4)
    over = lambda c: F.round(F.try_divide(F.col(c), F.col("_baseline")), 4)
    columns = {f"return_{n}d": change(f"c{n}") for n in returns}
    for n in paths:
        columns |= {f"max_gain_{n}d": change(f"max_close_{n}d"), f"max_drawdown_{n}d": change(f"min_close_{n}d")}
    columns |= {f"volume_spike_{n}d": over(f"max_volume_{n}d") for n in spikes} | {f"abnormal_volume_{n}d": over(f"mean_volume_{n}d") for n in abnormal}
    return found.select("ticker", day, F.col("c0").alias("price_at_signal"), *(v.alias(c) for c, v in columns.items()))


def market_outcomes(events: DataFrame, prices: DataFrame, key: str, day: str, benchmark: str, against: tuple[int, ...] = (7, 30)) -> DataFrame:
    """DF9: what the market did after each event, and its return over the benchmark's from the same day on."""
    days = _days(events, day)
    every = days.unionByName(days.select(F.lit(benchmark).alias("ticker"), day)).distinct()
    facts = written(day_outcomes(written(every), prices, day, lex.DAY_HORIZONS, (7, 14, 30), (3, 7, 14, 30), (7, 30)))
    marks = facts.filter(F.col("ticker") == benchmark).select(day, *(F.col(f"return_{n}d").alias(f"benchmark_return_{n}d") for n in against))
    out = events.select(key, "ticker", day).join(facts, ["ticker", day], "left").join(marks, day, "left")
    excess = {f"excess_return_{n}d": F.round(F.col(f"return_{n}d") - F.col(f"benchmark_return_{n}d"), 4) for n in against}
    return out.withColumns(excess).select(key, "ticker", day, *facts.drop("ticker", day).columns, *(f"benchmark_return_{n}d" for n in against), *excess)


def fetch_plan(events: DataFrame, day: str, back: int = 60, ahead: int = 45) -> DataFrame:
    """SRC17: the range of bars that each ticker's events need."""
    return events.groupBy("ticker").agg(F.date_sub(F.min(day), back).alias("first_day"), F.date_add(F.max(day), ahead).alias("last_day"))


def cache_is_sufficient(plan: DataFrame, prices: DataFrame, today: Column) -> DataFrame:
    """SRC16."""
    have = prices.groupBy("ticker").agg(F.min("date").alias("have_first"), F.max("date").alias("have_last"))
    enough = (F.col("have_first") <= F.col("first_day")) & (F.col("have_last") >= F.least("last_day", today))
    return plan.join(have, "ticker", "left").withColumn("sufficient", F.coalesce(enough, F.lit(False)))


def with_placeholders(prices: DataFrame, wanted: DataFrame) -> DataFrame:
    """SNK8: unavailable rows for wanted (ticker, date) without a bar; existing bars are never touched."""
    missing = wanted.select("ticker", "date").distinct().join(prices, ["ticker", "date"], "left_anti").withColumn("price_available", F.lit(False))
    return prices.unionByName(missing, allowMissingColumns=True)
