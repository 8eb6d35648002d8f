"""Classification of items: the deterministic classifier, normalisation of model answers, deeper analysis (DF1-DF4, ARR4-7)."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..functions import scores as S
from ..functions import text as T


# What the deterministic classifier says.
NO_ENTITY = "No confident stock ticker or company reference was identified."
BULL_CASE = "Post argues for improving fundamentals, upside, or business momentum."
BEAR_CASE = "Post points to downside risk, dilution, or execution concerns."


class Classifier(Protocol):
    """Adds the columns of a classification to items that have ``tickers``; a served model implements it with mapInPandas."""

    def __call__(self, items: DataFrame) -> DataFrame: ...


def fallback(
    items: DataFrame, bullish=lex.BULLISH_TERMS, bearish=lex.BEARISH_TERMS, hype=lex.FALLBACK_HYPE_TERMS, finance=lex.FINANCE_TERMS,
) -> DataFrame:
    """DF2: sentiment by term counts. Needs thread_title, body_text, tickers, company_names."""
    title, body = T.empty_if_null(F.col("thread_title")), T.empty_if_null(F.col("body_text"))
    # a column of its own: lowered once, not for every term
    low = F.col("_low")
    counted = items.withColumn("_low", F.lower(F.trim(F.concat_ws(" ", title, body))))
    counted = counted.withColumns({"_bull": T.hits(low, bullish), "_bear": T.hits(low, bearish), "_hype": T.hits(low, hype), "_spec": S.specificity(low, finance, True), "_rep": S.repetition(low, lowered=low)})
    known = (F.size(F.coalesce("tickers", F.array())) > 0) | (F.size(F.coalesce("company_names", F.array())) > 0)
    bull, bear, hyped, spec = F.col("_bull"), F.col("_bear"), F.col("_hype"), F.col("_spec")
    sentiment = F.when(~known, "irrelevant").when(bull > bear, "bullish").when(bear > bull, "bearish").otherwise("neutral")
    quality = F.when((bull + bear > 0) | (spec >= 6), "medium").otherwise("low")
    depth = F.least(2 + bull + bear + F.floor(spec / 2), F.lit(10)).cast("int")
    flags = F.array_compact(
        F.array(
            F.lit("fallback classifier"), F.when(hyped > 0, "pump language"), F.when(quality == "low", "no evidence"),
            F.when(low.contains("next tesla"), "comparison hype"),
        )
    )
    return counted.withColumns(
        {
            "sentiment": sentiment, "confidence": F.when(known, 0.45).otherwise(0.35), "evidence_quality": F.when(known, quality).otherwise("low"),
            "depth_score": F.when(known, depth).otherwise(0), "hype_score": F.when(known, F.least(hyped * 3, F.lit(10))).otherwise(0),
            "claim_specificity_score": spec, "repetition_score": F.col("_rep"),
            "needs_deeper_analysis": known & ((depth >= 7) | (spec >= 7)),
            "red_flags": F.when(known, flags).otherwise(F.array(F.lit("fallback classifier"), F.lit("unknown ticker/company"))),
            "summary": F.when(known, F.trim(F.substring(F.when(body != "", body).otherwise(title), 1, 220))).otherwise(NO_ENTITY),
            "bull_case": F.when(known & (bull > 0), BULL_CASE).otherwise(""), "bear_case": F.when(known & (bear > 0), BEAR_CASE).otherwise(""),
            "classifier_mode": F.lit("fallback"),
        }
    ).drop("_bull", "_bear", "_hype", "_spec", "_rep", "_low")


def with_scores(classified: DataFrame) -> DataFrame:
    """DF1: alpha, hype-adjusted alpha and claims to verify of classified items."""
    alpha = S.alpha(
        F.col("thread_title"), F.col("body_text"), F.col("score"), F.col("depth_score"), F.col("evidence_quality"), F.col("confidence"),
        F.col("claim_specificity_score"), F.col("hype_score"), F.col("bear_case"), F.size("red_flags"), F.col("summary"),
    )
    scored = classified.withColumn("alpha_signal_score", alpha)
    return scored.withColumns(
        {
            "hype_adjusted_signal_score": S.hype_adjusted(F.col("alpha_signal_score"), F.col("hype_score"), F.col("repetition_score")),
            "claims_to_verify": T.claims_to_verify(F.trim(F.concat_ws(" ", "thread_title", "body_text"))),
        }
    )


def parsed_answer(content: Column) -> Column:
    """ARR4: a model's JSON answer as a VARIANT; else what stands between its first and last brace; null where neither is an object."""
    object_ = lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), v)
    inner = F.regexp_extract(content, r"(?s)(\{.*\})", 1)
    return F.coalesce(object_(F.try_parse_json(content)), object_(F.try_parse_json(inner)))


def _normal(answer: Column, allowed: Column) -> dict[str, Column]:
    """DF3, ARR4-6, NUM3-5: the columns of a classification from a loose answer.

    Absent fields have their defaults; texts are trimmed; scores lie within their bounds and are the least one where they are no
    numbers; a text counts as a list of one; tickers are those of ``allowed`` alone, once each.
    """
    raw = lambda c: F.try_variant_get(answer, f"$.{c}", "variant")
    kind = lambda c: F.coalesce(F.schema_of_variant(raw(c)), F.lit("VOID"))
    text = lambda c: F.trim(F.coalesce(F.try_variant_get(answer, f"$.{c}", "string"), F.lit("")))
    number = lambda c: F.try_variant_get(answer, f"$.{c}", "double")
    bounded = lambda c: S.clamp(F.coalesce(number(c), F.lit(0.0)), 0, 10).cast("int")
    one_of = lambda c, values, default: F.when(F.lower(text(c)).isin(*values), F.lower(text(c))).otherwise(default)
    case = lambda c: F.when(F.lower(text(c)).isin("true", "false", "null", "none"), "").otherwise(text(c))

    def texts(c: str) -> Column:
        many = F.when(kind(c).startswith("ARRAY"), F.try_variant_get(answer, f"$.{c}", "array<string>")).when(kind(c) == "STRING", F.array(text(c)))
        return F.filter(F.transform(F.coalesce(many, F.array()), lambda t: F.trim(F.coalesce(t, F.lit("None")))), lambda t: t != "")

    flag = F.when(kind("needs_deeper_analysis") == "STRING", S.coerce_bool(text("needs_deeper_analysis"))).otherwise(
        F.coalesce(number("needs_deeper_analysis") != 0, F.try_variant_get(answer, "$.needs_deeper_analysis", "boolean"), F.lit(False))
    )
    return {
        "sentiment": one_of("sentiment", lex.ALL_SENTIMENTS, "irrelevant"), "evidence_quality": one_of("evidence_quality", lex.QUALITY_WEIGHTS, "low"),
        "confidence": F.when(raw("confidence").isNull(), 0.3).otherwise(S.clamp(F.coalesce(number("confidence"), F.lit(0.0)), 0, 1)),
        "tickers": F.array_intersect(F.transform(texts("tickers"), F.upper), F.coalesce(allowed, F.array())),
        "summary": text("summary"), "bull_case": case("bull_case"), "bear_case": case("bear_case"), "needs_deeper_analysis": flag,
        **{c: bounded(c) for c in ("depth_score", "hype_score", "claim_specificity_score", "repetition_score")},
        "red_flags": texts("red_flags"), "claims_to_verify": texts("claims_to_verify"),
    }


def normalised_answer(items: DataFrame, content: str = "content", allowed: str = "allowed_tickers") -> DataFrame:
    """DF3: the columns of a classification from each row's answer."""
    return items.withColumn("_a", parsed_answer(F.col(content))).withColumns(_normal(F.col("_a"), F.col(allowed))).drop("_a")


def answered(items: DataFrame, answers: DataFrame, finance=lex.FINANCE_TERMS, phrases=lex.REPETITION_PHRASES, **terms) -> DataFrame:
    """DF3 with DF1's retries: landed model answers where one can be read, the deterministic classifier's view elsewhere.

    answers: item_id, attempt, content; an item's first attempt that holds an object counts, the others were retried. What an answer
    leaves out is derived from the text: specificity and repetition of 0, claims that are none. Items have tickers and
    company_names, as they were offered to the model; ``classifier_mode`` tells whose view it is.
    """
    usable = answers.select("item_id", "attempt", "content").filter(parsed_answer(F.col("content")).isNotNull())
    best = usable.groupBy("item_id").agg(F.min_by("content", "attempt").alias("_content"))
    base = fallback(items, finance=finance, **terms).join(best, "item_id", "left").withColumn("_a", parsed_answer(F.col("_content")))
    body = F.trim(F.concat_ws(" ", "thread_title", "body_text"))
    view = _normal(F.col("_a"), F.col("tickers"))
    derived = {"claim_specificity_score": S.specificity(body, finance), "repetition_score": S.repetition(body, phrases)}
    for c, d in derived.items():
        view[c] = F.when(view[c] != 0, view[c].cast("long")).otherwise(d)
    claims = T.claims_to_verify(body)
    view["claims_to_verify"] = F.when(F.size(view["claims_to_verify"]) > 0, view["claims_to_verify"]).otherwise(claims)
    name = lambda t: F.get(F.coalesce("company_names", F.array()), F.array_position("tickers", t).cast("int") - 1)
    view["company_names"] = F.transform(view["tickers"], lambda t: F.coalesce(name(t), F.lit("Unknown")))
    view["classifier_mode"] = F.lit("ollama")
    ours = {c: F.col(c) for c in view if c != "claims_to_verify"} | {"claims_to_verify": claims}
    return base.withColumns({c: F.when(F.col("_a").isNotNull(), v).otherwise(ours[c]) for c, v in view.items()}).drop("_a", "_content")


def deeper(classified: DataFrame) -> DataFrame:
    """DF4: the deterministic deeper analysis as one struct."""
    body = T.empty_if_null(F.col("body_text"))
    return classified.withColumn(
        "deeper_analysis",
        F.struct(
            F.when(F.col("summary") != "", F.col("summary")).otherwise(F.substring(body, 1, 220)).alias("stronger_summary"),
            T.claims_to_verify(body).alias("key_claims"), T.catalysts(body).alias("possible_catalysts"), T.risks(body).alias("possible_risks"),
        ),
    )


def eligible_for_deeper(classified: DataFrame) -> Column:
    """FLT11."""
    return (F.col("depth_score") >= 7) | (F.col("evidence_quality") == "high") | F.col("needs_deeper_analysis")
