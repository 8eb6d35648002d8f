"""Statistics over signal and outcome columns: grids, ranks, rolling, descriptive, regression (ST1-10, ST14-15, ST18, AGG13, AGG25, WIN15, WIN17, JN21, FLT7, TOP8, SC20-21)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..sources.storage import written
from . import ranges


#: A correlation is perfect beyond this; sums of squares leave it an ulp or two below 1.
ONE = 1 - 1e-12


def long_pairs(df: DataFrame, key: list[str], signals: list[str], outcomes: list[str]) -> DataFrame:
    """key, signal, outcome, x, y for every pair of columns: one pass for a whole grid (ST8, AGG24)."""
    xs = F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("x")) for s in signals])
    ys = F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(o).cast("double").alias("y")) for o in outcomes])
    return df.select(*key, F.explode(xs).alias("s"), ys.alias("ys")).select(*key, "s.*", F.explode("ys").alias("o")).select(*key, "signal", "x", "o.*")


def pearson(x: Column | str, y: Column | str) -> Column:
    """ST2: null where either is constant."""
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def erfc(z: Column) -> Column:
    """ST5: complementary error function for z >= 0, Abramowitz and Stegun 7.1.26 (error below 1.5e-7)."""
    t = 1 / (1 + z * 0.3275911)
    # The approximation's coefficients, highest power first.
    poly = F.lit(0.0)
    for c in (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592):
        poly = (poly + c) * t
    return poly * F.exp(-z * z)


def p_value(r: Column, n: Column, kendall: bool = False) -> Column:
    """ST5: normal approximation; null for n < 3 or |r| = 1."""
    if kendall:
        z = r * F.sqrt(9 * n * (n - 1) / (2 * (2 * n + 5)))
    else:
        z = r * F.sqrt((n - 2) / F.greatest(1 - r * r, F.lit(1e-12)))
    return F.when((n >= 3) & (F.abs(r) < ONE), erfc(F.abs(z) / math.sqrt(2)))


def interval(r: Column, n: Column) -> tuple[Column, Column]:
    """ST6: Fisher's interval; null for n <= 3 or |r| = 1."""
    margin = F.lit(1.96) / F.sqrt(n - 3)
    ok = (n > 3) & (F.abs(r) < ONE)
    return tuple(F.when(ok, F.tanh(F.atanh(r) + sign * margin)) for sign in (-1, 1))


def _described(df: DataFrame, kendall: bool = False) -> DataFrame:
    """Adds rounded r, p, interval and labels to (signal, outcome, n, missing, r)."""
    r, n = F.col("r"), F.col("sample_size")
    low, high = interval(r, n)
    return df.select(
        "signal", "outcome", "sample_size", "missing_count", F.round(r, 6).alias("correlation"), F.round(p_value(r, n, kendall), 5).alias("p_value"),
        F.round(low, 5).alias("ci_low"), F.round(high, 5).alias("ci_high"), S.sample_reliability(n).alias("reliability"), S.effect_size(F.round(r, 6)).alias("effect"),
    )


def _complete(pairs: DataFrame) -> DataFrame:
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) != F.lit(float("inf"))), F.col(c))
    return pairs.withColumns({"x": finite("x"), "y": finite("y")})


def pearson_grid(pairs: DataFrame) -> DataFrame:
    """ST1, ST2 over (signal, outcome, x, y). Nulls in either are counted as missing."""
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    p = _complete(pairs).withColumn("_ok", both).withColumns({"x": F.when(F.col("_ok"), F.col("x")), "y": F.when(F.col("_ok"), F.col("y"))})
    return _described(p.groupBy("signal", "outcome").agg(F.count_if("_ok").alias("sample_size"), F.count_if(~F.col("_ok")).alias("missing_count"), pearson("x", "y").alias("r")))


def average_ranks(pairs: DataFrame) -> DataFrame:
    """WIN17: x and y replaced by their average ranks within (signal, outcome), from counts per distinct value.

    Only distinct values are ordered, by ranges, so neither a value nor a pair of columns is a task's work.
    """
    key, out = ["signal", "outcome"], pairs
    for c in "xy":
        counts = pairs.groupBy(*key, c).agg(F.count(F.lit(1)).alias("_c"))
        out = out.join(ranges.average_ranks(counts, key, c, "_c", f"_r{c}").drop("_c"), [*key, c])
    return out.withColumns({"x": F.col("_rx"), "y": F.col("_ry")}).drop("_rx", "_ry")


def spearman_grid(pairs: DataFrame) -> DataFrame:
    """ST3: Pearson of average ranks."""
    p = _complete(pairs)
    ok = p.filter("x is not null and y is not null")
    ranked = average_ranks(ok).groupBy("signal", "outcome").agg(F.count(F.lit(1)).alias("sample_size"), pearson("x", "y").alias("r"))
    missing = p.groupBy("signal", "outcome").agg(F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("missing_count"))
    return _described(missing.join(ranked, ["signal", "outcome"], "left").fillna(0, ["sample_size"]))


#: Ranks of y in a block of running weights.
RANKS = 1 << 12


def kendall_grid(pairs: DataFrame) -> DataFrame:
    """ST4: tau-b, from counts per distinct (x, y) cell in O(n log n), all in Spark.

    Ranks of two x part at one bit, below which they share a prefix. So for each bit and prefix the cells with that bit meet the
    weights without it, as running sums along y: per block of y's ranks, on top of the blocks' totals.
    """
    key = ["signal", "outcome"]
    p = _complete(pairs)
    cells = written(p.filter("x is not null and y is not null").groupBy(*key, "x", "y").agg(F.count(F.lit(1)).alias("w")))
    tops = None
    for c in "xy":
        # one row per distinct value is ordered, by ranges
        ranks = written(ranges.numbered(cells.groupBy(*key, c).agg(F.sum("w").alias("_c")), key, [c], f"_r{c}").withColumn(f"_r{c}", F.col(f"_r{c}") - 1))
        cells = cells.join(ranks.select(*key, c, f"_r{c}"), [*key, c])
        same = (F.col("_c").cast("decimal(38,0)") * (F.col("_c") - 1)).cast("decimal(38,0)")
        top = ranks.groupBy(*key).agg(F.sum(same).alias(f"same_{c}"), *([F.sum("_c").alias("sample_size"), F.max("_rx").alias("_top")] if c == "x" else []))
        tops = top if tops is None else tops.join(top, key)

    bits = F.length(F.bin("_top")).cast("int")
    levels = cells.join(tops.select(*key, "_top"), key).select(*key, "_rx", "_ry", "w", F.explode(F.sequence(F.lit(0), bits - 1)).alias("_bit"))
    shifted = F.expr("shiftright(_rx, _bit)")
    split = levels.select(*key, "_bit", F.shiftright(shifted, 1).alias("_prefix"), (shifted % 2 == 1).alias("_right"), "_ry", F.floor(F.col("_ry") / RANKS).alias("_block"), "w")
    left = F.sum(F.when(F.col("_right"), 0).otherwise(F.col("w")))
    group = [*key, "_bit", "_prefix"]
    rows = split.groupBy(*group, "_block", "_ry").agg(left.alias("_left"), F.sum(F.when(F.col("_right"), F.col("w")).otherwise(0)).alias("_own"))
    blocks = rows.groupBy(*group, "_block").agg(F.sum("_left").alias("_sum"))
    whole = Window.partitionBy(*group)
    earlier = F.coalesce(F.sum("_sum").over(whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select(*group, "_block", earlier.alias("_earlier"), F.sum("_sum").over(whole).alias("_all"))
    within = F.sum("_left").over(Window.partitionBy(*group, "_block").orderBy("_ry").rowsBetween(Window.unboundedPreceding, 0))
    upto = rows.withColumn("_upto", within).filter("_own > 0").join(blocks, [*group, "_block"]).withColumn("_upto", F.col("_upto") + F.col("_earlier"))
    # weights below y, less those above it
    margin = (F.col("_upto") - F.col("_left")) - (F.col("_all") - F.col("_upto"))
    scores = upto.groupBy(*key).agg(F.sum((F.col("_own").cast("decimal(19,0)") * margin.cast("decimal(19,0)")).cast("decimal(38,0)")).cast("double").alias("_score"))
    n = F.col("sample_size").cast("decimal(19,0)")
    untied = lambda c: ((n * (n - 1)).cast("decimal(38,0)") - F.col(f"same_{c}")).cast("double") / 2
    found = tops.join(scores, key, "left").select(*key, "sample_size", F.try_divide(F.coalesce("_score", F.lit(0.0)), F.sqrt(untied("x") * untied("y"))).alias("r"))
    missing = p.groupBy(*key).agg(F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("missing_count"))
    return _described(missing.join(found, key, "left").fillna(0, ["sample_size"]), kendall=True)


def rolling_correlation(df: DataFrame, x: str, y: str, order: list[str], window: int = 30, by: list[str] | None = None) -> DataFrame:
    """WIN15: Pearson over the last ``window`` complete rows, null below min(max(8, window // 2), window) rows.

    ``by``: keys that each have a series of their own. Without them all rows form one, in the order of a day column and of what
    follows it: rows are numbered within their day on top of the earlier days' counts (a row per day is ordered), and blocks of
    numbers, each with the ``window`` - 1 rows before it, have windows of their own.
    """
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    if not by:
        day, *rest = order
        days = rows.groupBy(day).agg(F.count(F.lit(1)).alias("_c"))
        days = days.withColumn("_before", F.sum("_c").over(Window.orderBy(day).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")).drop("_c")
        nth = F.row_number().over(Window.partitionBy(day).orderBy(*(rest or [day])))
        rows = rows.withColumn("_nth", nth).join(days, day).withColumn("_i", F.col("_before") + F.col("_nth") - 1)
        own = F.floor(F.col("_i") / RANKS)
        again = F.when((F.col("_i") % RANKS) > RANKS - window, F.array(own, own + 1)).otherwise(F.array(own))
        rows = rows.withColumn("_own", own).withColumn("_block", F.explode(again)).drop("_nth", "_before")
        by, order = ["_block"], ["_i"]
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(window - 1), 0)
    n = F.count(F.lit(1)).over(w)
    r = F.try_divide(F.covar_pop(x, y).over(w), F.nullif(F.stddev_pop(x).over(w) * F.stddev_pop(y).over(w), F.lit(0.0)))
    out = rows.withColumn("rows_in_window", n).withColumn("rolling_correlation", F.when(n >= min(max(8, window // 2), window), F.round(r, 5)))
    return out.filter("_own = _block").drop("_own", "_block", "_i") if by == ["_block"] else out


def rolling_ranks(df: DataFrame, x: str, y: str, order: list[str], method: str, window: int = 30, by: list[str] | None = None) -> DataFrame:
    """WIN15 by rank: Spearman's or Kendall's (tau-b) correlation over the last ``window`` complete rows, null below as for Pearson.

    Rows are numbered within their series by ranges, and cut into blocks of ``RANKS`` numbers that each also have the
    ``window`` - 1 rows before, so a series is spread. In a block all windows are one array: the signs of a window's pairwise
    differences give Kendall's pairs, and their sums over a row its rank within the window, less the mean.
    """
    by = by or []
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    rows = ranges.numbered(rows, by, order, "_i").withColumn("_i", F.col("_i") - 1)
    own = F.floor(F.col("_i") / RANKS)
    again = F.when((F.col("_i") % RANKS) > RANKS - window, F.array(own, own + 1)).otherwise(F.array(own))
    rows = rows.withColumn("_own", own).withColumn("_block", F.explode(again))
    least, names = min(max(8, window // 2), window), df.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("_i")
        inside = block["_own"].to_numpy() == block["_block"].to_numpy()
        signs = []
        for c in (x, y):
            v = np.concatenate((np.full(window - 1, np.nan), block[c].cast(pa.float64()).to_numpy()))
            signs.append(np.lib.stride_tricks.sliding_window_view(v, window))
        kept = np.flatnonzero(inside)
        first = block["_i"].to_numpy()[kept]
        n = np.minimum(first + 1, window)
        out = np.empty(len(kept))
        for a in range(0, len(kept), 256):
            some = kept[a : a + 256]
            sx, sy = (np.nan_to_num(np.sign(s[some][:, :, None] - s[some][:, None, :])) for s in signs)
            if method == "spearman":
                sx, sy = sx.sum(axis=2), sy.sum(axis=2)
            else:
                sx, sy = (s.reshape(len(some), -1) for s in (sx, sy))
            both = np.sqrt((sx * sx).sum(axis=1) * (sy * sy).sum(axis=1))
            with np.errstate(divide="ignore", invalid="ignore"):
                out[a : a + 256] = (sx * sy).sum(axis=1) / both
        out = block.filter(pa.array(inside)).select(names).append_column("rows_in_window", pa.array(n)).append_column("r", pa.array(out, mask=~np.isfinite(out)))
        return out

    found = rows.groupBy(*by, "_block").applyInArrow(run, f"{kinds}, rows_in_window long, r double")
    return found.withColumn("rolling_correlation", F.when(F.col("rows_in_window") >= least, F.round("r", 5))).drop("r")


def rolling_reading(rolling: DataFrame, order: list[str]) -> DataFrame:
    """ST15: what a rolling correlation tells, from its spread and its first and last values, in one row."""
    at = F.struct(*order)
    r = F.col("rolling_correlation")
    found = rolling.filter(r.isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.min_by(r, at).alias("first"), F.max_by(r, at).alias("last"), F.coalesce(F.stddev_samp(r), F.lit(0.0)).alias("sd"))
    # The sentences.
    reading = (
        F.when(F.col("n") < 3, "Rolling correlation is based on a small sample and may not be reliable.")
        .when(F.col("sd") > 0.35, "Correlation is unstable over time, so this signal should be treated cautiously.")
        .when(F.col("last") > F.col("first") + 0.12, "The relationship has strengthened over the selected rolling window.")
        .when(F.col("last") < F.col("first") - 0.12, "The relationship was stronger earlier and has recently weakened.")
        .otherwise("The rolling relationship is broadly stable under the selected window.")
    )
    return found.select("n", "first", "last", F.round("sd", 6).alias("sd"), reading.alias("reading"))


def raw_or_abnormal(grid: DataFrame, raw: str, abnormal: str) -> DataFrame:
    """JN21, ST14: by signal, its correlations with a raw and a market-adjusted outcome and what the pair with the widest gap tells."""
    side = lambda outcome, name: grid.filter(F.col("outcome") == outcome).select("signal", *(F.col(c).alias(f"{name}_{c}") for c in ("correlation", "p_value", "sample_size")))
    return side(raw, "raw").join(side(abnormal, "abnormal"), "signal", "full_outer")


def abnormal_reading(comparison: DataFrame) -> DataFrame:
    """ST14 in one row."""
    gap = F.abs(F.abs("raw_correlation") - F.abs("abnormal_correlation"))
    best = comparison.agg(F.max_by(F.struct("raw_correlation", "abnormal_correlation"), F.struct(F.coalesce(gap, F.lit(-1.0)), "signal")).alias("b"))
    raw, abnormal = F.abs("b.raw_correlation"), F.abs("b.abnormal_correlation")
    # The sentences.
    return best.select(
        F.when(F.col("b").isNull(), "No raw versus abnormal comparison is available for the selected filters.")
        .when(raw.isNull() | abnormal.isNull(), "Some comparison cells still lack enough complete price data.")
        .when(raw > abnormal + 0.08, "The raw return relationship is stronger than the abnormal return relationship, suggesting broader market movement may explain part of the result.")
        .when((abnormal >= raw - 0.03) & (abnormal >= 0.1), "The abnormal return relationship remains visible after market adjustment, so the pattern may be more ticker-specific.")
        .otherwise("No meaningful abnormal return relationship was found under the current filters.").alias("reading")
    )


def strongest(grid: DataFrame) -> DataFrame:
    """TOP8: the most positive, the most negative and the strongest correlation of a grid; ties by name."""
    pair = F.struct("signal", "outcome", "correlation")
    name = lambda c: F.struct(c, "signal", "outcome")
    r = F.col("correlation")
    best = grid.filter(r.isNotNull()).agg(F.max_by(pair, name(r)).alias("positive"), F.min_by(pair, name(r)).alias("negative"), F.max_by(pair, name(F.abs(r))).alias("absolute"))
    return best.unpivot([], ["positive", "negative", "absolute"], "kind", "b").select("kind", "b.*")


#: Signals by group.
GROUPS = {
    "Attention": ("mentions", "mention_share_of_voice", "mention_acceleration", "percentage_mention_acceleration", "post_count", "comment_count"),
    "Quality": ("average_hype_score", "average_evidence_score", "average_specificity_score", "low_mentions_high_signal_flag"),
    "Sentiment": ("average_sentiment_score", "bullish_mention_count", "bearish_mention_count", "bull_bear_ratio", "narrative_shift_score"),
    "Spread": ("unique_subreddit_count", "unique_author_count", "unique_thread_count"),
}


def heatmap(grid: DataFrame, mode: str = "all", min_r: float = 0.0, max_p: float = 1.0, min_n: int = 0, returns: str = "", kind: str = "any", group: str | None = None, top: int = 20) -> DataFrame:
    """FLT7: cells of a grid by strength, p, size, mode, outcome window, kind of outcome and group of signals."""
    r, p = F.col("correlation"), F.coalesce("p_value", F.lit(1.0))
    out = grid.filter(r.isNotNull() & (F.abs(r) >= min_r) & (p <= max_p) & (F.col("sample_size") >= min_n))
    if mode == "significant":
        out = out.filter("p_value < 0.05")
    elif mode == "reliable":
        out = out.filter(F.col("reliability").isin("Moderate evidence", "Stronger evidence"))
    elif mode in ("positive", "negative"):
        out = out.orderBy(F.desc(r) if mode == "positive" else F.asc(r), "signal", "outcome").limit(top)
    pattern = {"any": "", "abnormal": "abnormal_return", "raw": "raw_return", "volume": "volume|volatility"}[kind]
    out = out.filter(F.col("outcome").rlike(pattern) & F.col("outcome").contains(returns))
    return out.filter(F.col("signal").isin(*GROUPS[group])) if group else out


def trend_lines(pairs: DataFrame) -> DataFrame:
    """ST18: slope and intercept of y over x for each pair of columns."""
    ok = _complete(pairs).filter("x is not null and y is not null")
    return ok.groupBy("signal", "outcome").agg(F.round(F.regr_slope("y", "x"), 6).alias("slope"), F.round(F.regr_intercept("y", "x"), 6).alias("intercept"))


#: Bins of an interval in a round of selection, and values that are few enough to be looked at.
BINS, FEW = 256, 1024


def quantiles(df: DataFrame, columns: list[str], shares: tuple[float, ...]) -> dict[str, dict[float, float]]:
    """Exact quantiles by distributed selection: {column: {share: value}}, between neighbours by linear interpolation.

    A round counts the values of the intervals that hold the wanted ranks, by bins: first by sign, then by magnitude where the
    ends are far apart, else evenly. All are monotone, so the bin with a rank is the next interval, from its least value
    to its greatest. It ends when an interval has ``FEW`` values, which are then read, or one. No value map, no sort and no
    shuffle but of counts: ``BINS`` rows for each interval, of which a column has two for each share.
    """
    v = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c)
    rows = written(df.select(*map(v, columns))).unpivot([], columns, "variable", "v").filter("v is not null")
    sign = F.when(F.abs("v") == float("inf"), F.signum("v") * 2).otherwise(F.signum("v"))
    first = rows.groupBy("variable", sign.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    size = {c: sum(r["n"] for r in first if r["variable"] == c) for c in columns}
    # (column, rank) -> (values below the interval, values in it, its ends)
    open_: dict[tuple[str, int], tuple[int, int, float, float]] = {}
    for c in columns:
        for rank in {int(f(s * (size[c] - 1))) for s in shares for f in (math.floor, math.ceil)} if size[c] else ():
            open_[c, rank] = _within([(r["n"], r["lo"], r["hi"]) for r in first if r["variable"] == c], rank, 0)
    found: dict[tuple[str, int], float] = {}

    def settle() -> None:
        for k, (_, _, lo, hi) in list(open_.items()):
            if lo == hi:
                found[k] = lo
                del open_[k]

    settle()
    while wide := {(c, lo, hi) for (c, _), (_, n, lo, hi) in open_.items() if n > FEW}:
        bins = _of_intervals(rows, wide).groupBy("variable", "lo", "hi", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most")).collect()
        for (c, rank), (below, n, lo, hi) in open_.items():
            if n > FEW:
                open_[c, rank] = _within([(r["n"], r["least"], r["most"]) for r in bins if (r["variable"], r["lo"], r["hi"]) == (c, lo, hi)], rank, below)
        settle()
    if open_:
        values: dict[tuple[str, float, float], list] = {}
        for r in _of_intervals(rows, {(c, lo, hi) for (c, _), (_, _, lo, hi) in open_.items()}).groupBy("variable", "lo", "hi", "v").count().collect():
            values.setdefault((r["variable"], r["lo"], r["hi"]), []).append((r["count"], r["v"], r["v"]))
        for (c, rank), (below, _, lo, hi) in open_.items():
            found[c, rank] = _within(values[c, lo, hi], rank, below)[2]
    out: dict[str, dict[float, float]] = {c: {} for c in columns}
    for c in columns:
        for s in shares if size[c] else ():
            at = s * (size[c] - 1)
            low, part = math.floor(at), at - math.floor(at)
            out[c][s] = found[c, low] * (1 - part) + found[c, math.ceil(at)] * part if part else found[c, low]
    return out


def _within(bins: list[tuple[int, float, float]], rank: int, below: int) -> tuple[int, int, float, float]:
    """Of (count, least, greatest) the one with the rank, and how many values lie below it."""
    for n, lo, hi in sorted(bins, key=lambda b: b[1]):
        if rank < below + n:
            return below, n, lo, hi
        below += n
    raise ValueError(f"no value of rank {rank}")


def _of_intervals(rows: DataFrame, intervals: set[tuple[str, float, float]]) -> DataFrame:
    """The values of each interval with their bin; there are two intervals for each wanted share at most."""
    ends = rows.sparkSession.createDataFrame(sorted(intervals), "variable string, lo double, hi double")
    met = rows.join(F.broadcast(ends), "variable").filter("v between lo and hi")
    near, far, own = F.least(F.abs("lo"), F.abs("hi")), F.greatest(F.abs("lo"), F.abs("hi")), F.abs("v")
    magnitude = F.log(own / near) / F.log(far / near)
    even = (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    place = F.when((near > 0) & (far / near > BINS) & (far / near < float("inf")), magnitude).otherwise(even)
    return met.withColumn("bin", F.floor(place * BINS))


def quartiles(df: DataFrame, columns: list[str]) -> DataFrame:
    """AGG25: the five numbers of a box plot by variable; null without values."""
    shares = {"low": 0.0, "q1": 0.25, "middle": 0.5, "q3": 0.75, "high": 1.0}
    found = quantiles(df, columns, tuple(shares.values()))
    rows = [(c, *(found[c].get(s) for s in shares.values())) for c in columns]
    out = df.sparkSession.createDataFrame(rows, "variable string, " + ", ".join(f"{n} double" for n in shares))
    return out.withColumns({n: F.round(n, 6) for n in shares})


def descriptive(df: DataFrame, columns: list[str]) -> DataFrame:
    """AGG13: one row per variable, with the sample's bias-adjusted skewness and excess kurtosis."""
    kept = written(df.select(*(F.col(c).cast("double").alias(c) for c in columns)))
    middle = kept.sparkSession.createDataFrame([(c, q.get(0.5)) for c, q in quantiles(kept, columns, (0.5,)).items()], "variable string, median double")
    rows = kept.unpivot([], columns, "variable", "v")
    n = F.col("valid_n")
    out = rows.groupBy("variable").agg(
        F.count("v").alias("valid_n"), F.count_if(F.col("v").isNull()).alias("missing"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"),
        F.min("v").alias("minimum"), F.max("v").alias("maximum"), F.stddev_pop("v").alias("_p"), F.avg(F.pow("v", F.lit(3))).alias("_m3"), F.avg(F.pow("v", F.lit(4))).alias("_m4"), F.avg(F.pow("v", F.lit(2))).alias("_m2"),
    ).join(F.broadcast(middle), "variable")
    m = F.col("mean")
    c3 = F.col("_m3") - m * F.col("_m2") * 3 + F.pow(m, F.lit(3)) * 2
    c4 = F.col("_m4") - m * F.col("_m3") * 4 + F.pow(m, F.lit(2)) * F.col("_m2") * 6 - F.pow(m, F.lit(4)) * 3
    g1, g2 = F.try_divide(c3, F.pow("_p", F.lit(3))), F.try_divide(c4, F.pow("_p", F.lit(4))) - 3
    skew = F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0)))
    kurtosis = F.when(n > 3, F.try_divide((n - 1) * ((n + 1) * g2 + 6), (n - 2) * (n - 3)))
    rounded = {c: F.round(c, 4) for c in ("mean", "sd", "median", "minimum", "maximum")}
    return out.withColumns({"skewness": F.round(skew, 3), "kurtosis": F.round(kurtosis, 3)}).withColumns(rounded).drop("_p", "_m2", "_m3", "_m4")


def z_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """AGG17, WIN18: against the whole frame's mean and sample deviation, 0 where that is 0. One aggregated row is joined."""
    whole = df.agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.stddev_samp(c).alias(f"_s_{c}") for c in columns))
    out = df.join(F.broadcast(whole))
    for c in columns:
        out = out.withColumn(f"{c}_z", F.round(F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.nullif(F.col(f"_s_{c}"), F.lit(0.0))), F.lit(0.0)), 5))
    return out.drop(*whole.columns)


def regression(df: DataFrame, target: str, predictors: list[str]) -> dict[str, object] | None:
    """ST10: ordinary least squares with intercept. Spark aggregates X'X and X'y (k squared sums), the driver solves them.

    Null if fewer than k + 3 complete rows. Standard errors from the pseudo-inverse; normal p-values.
    """
    names = ["intercept", *predictors]
    columns = {n: F.lit(1.0) if n == "intercept" else F.col(n).cast("double") for n in names}
    rows = df.filter(" AND ".join(f"{c} IS NOT NULL" for c in [target, *predictors]))
    sums = [F.sum(columns[a] * columns[b]).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    y = F.col(target).cast("double")
    row = rows.agg(*sums, *(F.sum(columns[a] * y).alias(f"y_{i}") for i, a in enumerate(names)), F.sum(y * y).alias("yy"), F.count(F.lit(1)).alias("n")).first()
    n, k = row["n"], len(names)
    if n <= k + 1:
        return None
    xx = np.array([[row[f"{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    xy = np.array([row[f"y_{i}"] for i in range(k)])
    inverse = np.linalg.pinv(xx)
    beta = inverse @ xy
    rss = max(float(row["yy"] - beta @ xy), 0.0)
    tss = float(row["yy"] - xy[0] ** 2 / n)
    s2 = rss / (n - k)
    se = np.sqrt(np.maximum(np.diag(inverse) * s2, 0))
    p = [math.erfc(abs(b / s) / math.sqrt(2)) if s else None for b, s in zip(beta, se, strict=True)]
    r2 = 1 - rss / tss if tss else 0.0
    adjusted = 1 - (1 - r2) * (n - 1) / (n - k)
    f = (tss - rss) / (k - 1) / s2 if s2 and k > 1 else None
    terms = [{"term": t, "coefficient": float(b), "standard_error": float(s), "p_value": q, "ci_low": float(b - 1.96 * s), "ci_high": float(b + 1.96 * s)} for t, b, s, q in zip(names, beta, se, p, strict=True)]
    return {"n": n, "terms": terms, "r_squared": r2, "adjusted_r_squared": adjusted, "f_statistic": f, "residual_se": math.sqrt(s2)}


def with_predictions(df: DataFrame, fit: dict, target: str) -> DataFrame:
    """Predictions and residuals of a fitted regression, as a column expression."""
    out = F.lit(0.0)
    for t in fit["terms"]:
        out = out + (F.lit(t["coefficient"]) if t["term"] == "intercept" else F.col(t["term"]) * t["coefficient"])
    return df.withColumn("predicted", out).withColumn("residual", F.col(target) - F.col("predicted"))


def warnings(pairs: DataFrame) -> DataFrame:
    """ST7: flags per (signal, outcome), for the Pearson correlation: few rows, missing values, ties, an outlier, same day, weak, many."""
    p = _complete(pairs)
    ok = p.filter("x is not null and y is not null")
    stats = ok.groupBy("signal", "outcome").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("x").alias("dx"), F.countDistinct("y").alias("dy"), pearson("x", "y").alias("r"),
        F.avg("x").alias("mx"), F.stddev_samp("x").alias("sx"), F.avg("y").alias("my"), F.stddev_samp("y").alias("sy"),
    )
    missing = p.groupBy("signal", "outcome").agg(F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("missing"))
    z = lambda c: F.coalesce(F.abs(F.try_divide(F.col(c) - F.col(f"m{c}"), F.nullif(F.col(f"s{c}"), F.lit(0.0)))), F.lit(0.0))
    near = ok.join(stats.select("signal", "outcome", "mx", "sx", "my", "sy"), ["signal", "outcome"]).filter((z("x") <= 3.5) & (z("y") <= 3.5)).select("signal", "outcome", "x", "y")
    trimmed = average_ranks(near).groupBy("signal", "outcome").agg(pearson("x", "y").alias("r_trim"), F.count(F.lit(1)).alias("n_trim"))
    out = missing.join(stats, ["signal", "outcome"], "left").join(trimmed, ["signal", "outcome"], "left")
    n, tied = F.coalesce("n", F.lit(0)), lambda c: (n >= 8) & (F.col(f"d{c}") / n <= 0.12)
    # The flags.
    flags = F.array_compact(
        F.array(
            F.when(n < 20, "sample size too small"), F.when((n > 0) & (F.col("missing") / F.greatest(n + F.col("missing"), F.lit(1)) > 0.25), "many missing price values"),
            F.when(tied("x"), F.concat("signal", F.lit(" has many tied values"))).when(tied("y"), F.concat("outcome", F.lit(" has many tied values"))),
            F.when((n >= 12) & (F.col("n_trim") < n) & (F.col("n_trim") >= 8) & (F.abs(F.col("r") - F.col("r_trim")) >= 0.25), "correlation may be driven by one extreme outlier"),
            F.when(F.col("outcome").contains("same_day"), "same-period relationship may be reactive rather than predictive"),
            F.when(F.col("outcome").contains("abnormal_return") & (F.abs(F.coalesce("r", F.lit(0.0))) < 0.05), "market-adjusted relationship is very weak"),
            F.lit("multiple comparisons can create false positives"),
        )
    )
    return out.select("signal", "outcome", F.array_join(flags, "; ").alias("warnings"))
