"""Score formulas over columns (SC1-SC26, NUM1-7). Every score is clamped and rounded to two digits unless said."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as lex
from . import text as T


def clamp(x: Column, low: float = 0, high: float = 100) -> Column:
    """Between low and high; null stays null."""
    return F.when(x.isNull(), None).otherwise(F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def at_least(x: Column, low: float) -> Column:
    return F.greatest(x, F.lit(low))


def at_most(x: Column, high: float) -> Column:
    return F.least(x, F.lit(high))


def specificity(text: Column, terms: Iterable[str] = lex.FINANCE_TERMS, lowered: bool = False) -> Column:
    """SC3: finance terms, two points for a digit, one for a link; 0 to 10. ``lowered``: the text is in lower case already."""
    low = text if lowered else F.lower(T.empty_if_null(text))
    points = T.hits(low, terms) + F.when(T.has_digit(low), 2).otherwise(0) + F.when(T.has_link(low), 1).otherwise(0)
    return F.least(points, F.lit(10)).cast("long")


def repetition(text: Column, phrases: Iterable[str] = lex.REPETITION_PHRASES, lowered: Column | None = None) -> Column:
    """SC4: runs of a repeated word, stock phrases, and words in capitals; 0 to 10. ``lowered``: the text in lower case, if a column has it."""
    low = F.lower(T.empty_if_null(text)) if lowered is None else lowered
    runs = F.regexp_count(low, F.lit(r"(?U)\b(\w+)\b(?:\W+\1\b)+"))
    capitals = F.size(F.filter(F.split(T.empty_if_null(text), r"\s+"), lambda w: (F.length(w) > 3) & (F.upper(w) == w) & (F.lower(w) != w)))
    return F.least(runs * 2 + T.hits(low, phrases) * 3 + F.least(capitals, F.lit(3)), F.lit(10)).cast("long")


def coerce_score(value: Column, derived: Column) -> Column:
    """SC5: a given value, clamped to 0 to 10 and cut to a whole number, a given 0 included; else the derived one."""
    given = F.trim(value.cast("string")).try_cast("double")
    return F.coalesce(F.floor(clamp(given, 0.0, 10.0)).cast("long"), derived)


def coerce_bool(value: Column) -> Column:
    """NUM4: what a loose answer means by true."""
    return F.coalesce(F.lower(F.trim(value)).isin("true", "1", "yes"), F.lit(False))


def lenient_time(value: Column) -> Column:
    """DT4: a date is its midnight in UTC; anything that is no time is null."""
    return F.trim(value.cast("string")).try_cast("timestamp")


def alpha(
    title: Column, body: Column, score: Column, depth: Column, quality: Column, confidence: Column, claim: Column, hype: Column,
    bear_case: Column, red_flags: Column, summary: Column,
    hype_terms=lex.HYPE_TERMS, specific_terms=lex.SPECIFICITY_TERMS, risk_terms=lex.RISK_TERMS, unproven_terms=lex.NO_EVIDENCE_TERMS,
    summary_terms=lex.SUMMARY_TERMS, lowered: Column | None = None,
) -> Column:
    """SC1: an item's signal, from its reception, the classifier's view of it, and what its words show. ``red_flags``: their number.

    ``lowered``: a column that has title and body in lower case, so that they aren't lowered for every term.
    """
    low = F.lower(F.concat_ws(" ", T.empty_if_null(title), T.empty_if_null(body))) if lowered is None else lowered
    hyped, specific, risky, unproven = (T.hits(low, t) for t in (hype_terms, specific_terms, risk_terms, unproven_terms))
    weight = F.lit(lex.QUALITY_WEIGHTS["low"])
    for name, points in lex.QUALITY_WEIGHTS.items():
        weight = F.when(quality == name, points).otherwise(weight)
    gains = (
        clamp(score, 0, 250) / 25 + clamp(depth, 0, 10) * 2.5 + weight + clamp(confidence, 0, 1) * 10 + clamp(claim, 0, 10) * 3.2
        + F.least(specific * 3, F.lit(12)) + F.when((risky > 0) | (T.empty_if_null(bear_case) != ""), 6).otherwise(0)
        + F.when(T.any_of(F.lower(T.empty_if_null(summary)), summary_terms), 4).otherwise(0)
    )
    losses = clamp(hype, 0, 10) * 4 + F.least(hyped * 8, F.lit(32)) + F.least(red_flags * 5, F.lit(20)) + F.least(unproven * 12, F.lit(24))
    total = gains - losses
    total = F.when((hyped >= 2) & (specific == 0), at_most(total, 35.0)).otherwise(total)
    total = F.when((unproven > 0) & (risky == 0), at_most(total, 25.0)).otherwise(total)
    return F.round(clamp(total), 2)


def hype_adjusted(alpha: Column, hype: Column, repetition: Column) -> Column:
    return F.round(clamp(alpha - hype * 4.5 - repetition * 1.5), 2)


def sentiment_number(sentiment: Column) -> Column:
    return F.when(sentiment == "bullish", 1.0).when(sentiment == "neutral", 0.0).when(sentiment == "bearish", -1.0)


def quality_number(quality: Column) -> Column:
    return F.when(quality == "high", 3).when(quality == "medium", 2).otherwise(1)


def growth(current: Column, previous: Column) -> Column:
    """SC9: null without an earlier value."""
    return F.when(previous > 0, F.round((current - previous) / previous, 4))


def bounded_growth(current: Column, previous: Column) -> Column:
    """SC14: from -1 to 4; from nothing, a quarter counts as one."""
    rise = F.when(current > 0, at_most(current / 0.25, 4.0)).otherwise(0.0)
    return F.when(F.coalesce(previous, F.lit(0.0)) <= 0, rise).otherwise(clamp(F.try_divide(current - previous, previous), -1.0, 4.0))


def diversity(sources: Column, communities: Column) -> Column:
    return F.round(F.least(sources * 2.5 + communities * 1.5, F.lit(10.0)), 2)


def controversy(bullish: Column, bearish: Column) -> Column:
    both = bullish + bearish
    return F.when(both > 0, F.round(F.least(bullish, bearish) * 2 / both * 10, 2)).otherwise(0.0)


def popularity_penalty(ticker: Column, mentions: Column, mega=lex.MEGA_CAPS) -> Column:
    extra = F.when(ticker.isin(*mega), 10.0).otherwise(0.0)
    return F.round(F.least(F.greatest(mentions - 12, F.lit(0)) * 0.8 + extra, F.lit(25.0)), 2)


def acceleration(current: Column, previous: Column, rate: Column, authors: Column, threads: Column, hype: Column, repetition: Column, is_new: Column) -> Column:
    """SC10. ``authors`` and ``threads``: their growth."""
    more_authors, more_threads = F.greatest(authors, F.lit(0)), F.greatest(threads, F.lit(0))
    new = 30 + current * 8 + more_authors * 4 + more_threads * 3
    old = (current - previous) * 9 + F.coalesce(rate, F.lit(0.0)) * 25 + more_authors * 5 + more_threads * 4
    points = F.when(is_new, new.cast("double")).otherwise(old)
    return F.round(clamp(points - F.greatest(hype - 4, F.lit(0.0)) * 4 - repetition * 1.2), 2)


def emerging(
    acceleration: Column, diversity: Column, alpha: Column, evidence: Column, claim: Column, hype: Column, repetition: Column, penalty: Column,
    low_mentions: Column, is_new: Column, change: Column, mentions: Column, sources: Column,
) -> Column:
    """SC11."""
    points = (
        acceleration * 0.45 + diversity * 2.8 + alpha * 0.28 + evidence * 6 + claim * 2.5
        + F.when((mentions <= 12) & (change > 0), 10).otherwise(0) + F.least(F.greatest(sources - 1, F.lit(0)) * 5, F.lit(15))
        + F.when(low_mentions, 12).otherwise(0) + F.when(is_new, 10).otherwise(0)
    )
    return F.round(clamp(points - hype * 2.2 - repetition * 1.4 - penalty), 2)


def coverage_reliability(kind: Column, canonical: Column, rate_limited: Column, feed_capped: Column, post_capped: Column, posts: Column, missed: Column) -> Column:
    """SC16: product of penalties, 0 to 1. ``missed``: share of the window that the source didn't reach."""
    small = F.when(posts == 0, 0.0).when(posts < 10, 0.55).when(posts < 30, 0.78).otherwise(1.0)
    parts = (
        F.when(canonical, 1.0).otherwise(0.65), F.when(kind == "thread_url", 0.7).otherwise(1.0), F.when(rate_limited, 0.2).otherwise(1.0),
        F.when(feed_capped, 0.45).otherwise(1.0), F.when(post_capped, 0.75).otherwise(1.0), small, F.when(missed > 0.35, 0.75).otherwise(1.0),
    )
    out = F.lit(1.0)
    for p in parts:
        out = out * p
    return F.round(clamp(out, 0.0, 1.0), 3)


def coverage_reasons(kind: Column, canonical: Column, rate_limited: Column, feed_capped: Column, post_capped: Column, posts: Column, missed: Column) -> Column:
    """SC16: why the reliability isn't full, in the order of its penalties."""
    # The reasons.
    found = F.array_compact(
        F.array(
            F.when(~canonical, "Discovery or comment-inclusive run; useful for evidence, weaker for acceleration."),
            F.when(kind == "thread_url", "Single-thread source; not a broad subreddit sample."),
            F.when(rate_limited, "Reddit rate limit affected collection."),
            F.when(feed_capped, "RSS cap was hit before the requested window was fully visible."),
            F.when(post_capped, "Configured post cap stopped collection before the feed was exhausted."),
            F.when(posts == 0, "No posts returned for this source.").when(posts < 10, "Very small post sample.").when(posts < 30, "Post sample is below the preferred 30-post trend minimum."),
            F.when(missed > 0.35, "Oldest returned post does not cover much of the requested window."),
        )
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("Comparable posts-only source sample.")))


def reliability_name(value: Column) -> Column:
    return F.when(value >= 0.8, "High").when(value >= 0.5, "Medium").otherwise("Low")


def attention_spread(mentions: Column, threads: Column, authors: Column, sources: Column, voice: Column) -> Column:
    """SC18."""
    return F.round(F.least(F.lit(100.0), mentions * 3.5 + threads * 5 + authors * 2.5 + sources * 10 + voice * 0.35), 2)


def signal_strength(emerging: Column, acceleration: Column, alpha: Column, hype: Column) -> Column:
    """SC19."""
    return F.round(emerging * 0.55 + acceleration * 0.25 + alpha * 0.2 - hype * 0.1, 4)


def interesting(r: Column, p: Column, n: Column, missing: Column, future: Column, abnormal: Column) -> Column:
    """SC20: how much a correlation deserves a look."""
    rate = F.coalesce(F.try_divide(missing, n + missing), F.lit(0.0))
    return F.round(
        F.abs(F.coalesce(r, F.lit(0.0))) * 0.52 + F.when(p < 0.05, 0.12).otherwise(0.0) + F.when(n >= 50, 0.2).otherwise(0.0)
        + F.when(future, 0.08).otherwise(0.0) + F.when(abnormal, 0.08).otherwise(0.0) - rate * 0.2, 6,
    )


def sample_reliability(n: Column) -> Column:
    # The labels.
    return F.when(n < 20, "Unreliable").when(n < 50, "Weak evidence").when(n < 100, "Moderate evidence").otherwise("Stronger evidence")


def effect_size(r: Column) -> Column:
    # The labels.
    a = F.abs(r)
    return F.when(r.isNull(), "no complete relationship").when(a < 0.1, "negligible").when(a < 0.3, "weak").when(a < 0.5, "moderate").otherwise("strong")


def evidence(p: Column) -> Column:
    """SC21: what a p-value says."""
    # The labels.
    return (
        F.when(p.isNull(), "not enough complete observations for a p-value").when(p < 0.001, "very strong statistical evidence")
        .when(p < 0.01, "strong statistical evidence").when(p < 0.05, "statistically significant").otherwise("not statistically significant")
    )


def market_freshness(latest: Column, missing: Column, now: Column) -> Column:
    """SC24: what the newest outcome's age, and missing ones, say of the market cache."""
    # The labels.
    hours = F.greatest((F.unix_micros(now) - F.unix_micros(latest)) / 3.6e9, F.lit(0.0))
    return (
        F.when(latest.isNull(), "Market cache needs refresh").when((hours <= 24) & ~missing, "Market cache fresh")
        .when(hours <= 72, "Market cache partial").otherwise("Market cache needs refresh")
    )


def trust(mode: Column, confidence: Column, quality: Column, hype: Column) -> Column:
    """SC17."""
    # The labels.
    return (
        F.when(mode == "fallback", "Fallback").when((confidence >= 0.7) & quality.isin("medium", "high") & (hype <= 6), "Strong")
        .when((confidence < 0.35) | (quality == "low"), "Review").otherwise("Standard")
    )


def bull_bear(bullish: Column, bearish: Column) -> Column:
    return F.round((bullish + 0.5) / (bearish + 0.5), 4)
