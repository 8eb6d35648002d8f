"""DuckDB SQL of the queries in :mod:`.queries`, written independently of the DataFrame code."""

from __future__ import annotations

from ..functions import lexicons as lex
from . import queries as Q

_M = """m AS (
    SELECT event_id AS item_id, upper(substr(event_type, 1, 2)) || CAST(k % 20 AS VARCHAR) AS ticker, upper(event_type) AS kind,
        CASE WHEN event_id % 7 = 0 THEN 'Unknown' ELSE event_type END AS company_name, CAST(user_id AS VARCHAR) AS author_hash,
        CAST(k AS VARCHAR) AS thread_id, 's' || CAST(user_id % 5 AS VARCHAR) AS source_name, 'r' || CAST(k % 3 AS VARCHAR) AS subreddit,
        CASE WHEN event_id % 3 = 0 THEN 'post' ELSE 'comment' END AS item_type,
        CASE WHEN value < 15 THEN 'bearish' WHEN value < 35 THEN 'neutral' WHEN value < 120 THEN 'bullish' ELSE 'irrelevant' END AS sentiment,
        CASE WHEN value < 15 THEN -1.0 WHEN value < 35 THEN 0.0 WHEN value < 120 THEN 1.0 END::DOUBLE AS sentiment_numeric,
        (event_id % 128) / 128 AS confidence, ((event_id * 37) % 400) / 4 AS alpha,
        greatest(((event_id * 37) % 400) / 4 - (event_id % 11) * 4.5::DOUBLE, 0::DOUBLE) AS adjusted,
        event_id % 11 AS hype, (event_id * 3) % 11 AS depth, (event_id * 5) % 11 AS claim,
        CASE event_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS quality, event_id % 3 + 1 AS quality_n, event_id % 4 AS rep,
        CASE WHEN event_id % 2 = 0 THEN 'fallback' ELSE 'model' END AS mode, event_id % 13 = 0 AS deeper, event_id % 17 = 0 AS lmhs, event_id % 19 = 0 AS is_new,
        ts AS created_time, CAST(ts AS DATE) AS created_date, CAST(date_trunc('week', ts) AS DATE) AS wk
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
)"""
_CLAMP = "round(greatest(least({}, 100), 0), 2)"


def _accel(cur: str, prev: str, rate: str, authors: str, threads: str, hype: str, rep: str, new: str) -> str:
    return _CLAMP.format(
        f"CASE WHEN {new} THEN 30 + {cur} * 8 + greatest({authors}, 0) * 4 + greatest({threads}, 0) * 3 "
        f"ELSE ({cur} - {prev}) * 9 + coalesce({rate}, 0) * 25 + greatest({authors}, 0) * 5 + greatest({threads}, 0) * 4 END::DOUBLE - greatest({hype} - 4, 0) * 4 - {rep} * 1.2::DOUBLE"
    )


_DIVERSITY = "round(least(n_source * 2.5::DOUBLE + n_sub * 1.5::DOUBLE, 10), 2)"
_PENALTY = "round(least(greatest(total_mentions - 12, 0) * 0.8::DOUBLE, 25), 2)"
_MEANS = """round(avg(alpha), 2) AS average_alpha_signal_score, round(avg(adjusted), 2) AS average_hype_adjusted_signal_score, round(avg(depth), 2) AS average_depth_score,
    round(avg(hype), 2) AS average_hype_score, round(avg(claim), 2) AS average_claim_specificity_score, round(avg(quality_n), 2) AS average_evidence_quality_numeric,
    round(avg(rep), 2) AS repetition_score"""
_COUNTS = """count(*) AS total_mentions, count(*) FILTER (sentiment = 'bullish') AS bullish_mentions, count(*) FILTER (sentiment = 'bearish') AS bearish_mentions,
    count(*) FILTER (sentiment = 'neutral') AS neutral_mentions"""
_EMERGING = _CLAMP.format(
    "acceleration_score * 0.45::DOUBLE + source_diversity_score * 2.8::DOUBLE + average_alpha_signal_score * 0.28::DOUBLE + average_evidence_quality_numeric * 6 + average_claim_specificity_score * 2.5::DOUBLE "
    "+ CASE WHEN total_mentions <= 12 AND mention_change > 0 THEN 10 ELSE 0 END + least(greatest(unique_sources - 1, 0) * 5, 15) + CASE WHEN low_mentions_high_signal THEN 12 ELSE 0 END "
    "+ CASE WHEN new_ticker_detected THEN 10 ELSE 0 END - average_hype_score * 2.2::DOUBLE - repetition_score * 1.4::DOUBLE - mega_popularity_penalty"
)
_LMHS = "total_mentions < 10 AND average_alpha_signal_score >= 75 AND average_hype_score < 4"


def _growth(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN round(({a} - {b}) / {b}, 4) END"


def _summary(keys: str, name: str = "summary") -> str:
    """CTEs that end in ``name``: the ticker summary grouped by ``keys``."""
    return f"""
    b AS (SELECT {keys}, wk, count(*) AS n, count(*) FILTER (sentiment = 'bullish') AS bull, count(DISTINCT author_hash) AS au, count(DISTINCT thread_id) AS th FROM m GROUP BY ALL),
    b2 AS (SELECT {keys}, wk, n, bull, au, th, coalesce(lag(n) OVER w, 0) AS pn, coalesce(lag(bull) OVER w, 0) AS pbull, coalesce(lag(au) OVER w, 0) AS pau, coalesce(lag(th) OVER w, 0) AS pth,
        round(avg(n) OVER (PARTITION BY {keys} ORDER BY wk ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS rolling, row_number() OVER (PARTITION BY {keys} ORDER BY wk DESC) AS rn
        FROM b WINDOW w AS (PARTITION BY {keys} ORDER BY wk)),
    t AS (SELECT {keys}, {_COUNTS}, round(avg(sentiment_numeric), 4) AS net_sentiment_score, round(avg(confidence), 4) AS average_confidence, {_MEANS},
        count(DISTINCT source_name) AS n_source, count(DISTINCT subreddit) AS n_sub, count(DISTINCT author_hash) AS unique_authors, count(DISTINCT thread_id) AS unique_threads,
        min(created_date) AS first_seen_date, max(created_date) AS most_recent_seen_date FROM m GROUP BY {keys}),
    s1 AS (SELECT t.* EXCLUDE (n_source, n_sub), n_source AS unique_sources, n AS mentions_this_period, pn AS mentions_previous_period, n - pn AS mention_change, {_growth("n", "pn")} AS mention_growth_rate,
        bull - pbull AS bullish_change, {_growth("bull", "pbull")} AS bullish_growth_rate, au - pau AS unique_author_growth, th - pth AS unique_thread_growth, rolling AS rolling_mention_average,
        round(bullish_mentions / total_mentions, 4) AS bullish_ratio, round(bearish_mentions / total_mentions, 4) AS bearish_ratio, {_DIVERSITY} AS source_diversity_score,
        CASE WHEN bullish_mentions + bearish_mentions > 0 THEN round(least(bullish_mentions, bearish_mentions) * 2 / (bullish_mentions + bearish_mentions) * 10, 2) ELSE 0 END::DOUBLE AS controversy_score,
        {_PENALTY} AS mega_popularity_penalty, pn = 0 AS new_ticker_detected, {_LMHS} AS low_mentions_high_signal
        FROM t JOIN b2 USING ({keys}) WHERE rn = 1),
    s2 AS (SELECT *, {_accel("mentions_this_period", "mentions_previous_period", "mention_growth_rate", "unique_author_growth", "unique_thread_growth", "average_hype_score", "repetition_score", "new_ticker_detected")} AS acceleration_score FROM s1),
    {name} AS (SELECT *, {_EMERGING} AS emerging_ticker_score FROM s2)"""


_WORDS = "regexp_extract_all(text, '[\\p{L}\\p{N}_]+')"

def _hits(terms, text: str = "low") -> str:
    return "(" + " + ".join(f"CASE WHEN contains({text}, '{t}') THEN 1 ELSE 0 END" for t in terms) + ")"


_D = f"""d AS (
    SELECT doc_id AS item_id, text, lower(text) AS low, source, lang, doc_id % 300 AS score, CAST(doc_id % 97 AS VARCHAR) AS author,
        list_filter({_WORDS}, lambda w: list_contains([{", ".join(repr(s) for s in Q.CATALOG if s not in Q.AMBIGUOUS)}], w)) AS sy FROM documents
), d2 AS (SELECT *, list_filter(sy, lambda w, i: list_position(sy, w) = i) AS symbols FROM d)"""
_SPEC = f"least({_hits(Q.FINANCE)} + CASE WHEN regexp_matches(low, '[0-9]') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(low, 'https?://|www\\.') THEN 1 ELSE 0 END, 10)"
_CLASS = f"""{_D}, c1 AS (SELECT *, len(symbols) > 0 AS known, {_hits(Q.BULLISH)} AS bull, {_hits(Q.BEARISH)} AS bear, {_hits(Q.HYPE)} AS hyped, {_SPEC} AS spec FROM d2),
c2 AS (SELECT *, CASE WHEN NOT known THEN 'irrelevant' WHEN bull > bear THEN 'bullish' WHEN bear > bull THEN 'bearish' ELSE 'neutral' END AS sentiment,
    CASE WHEN known THEN 0.45::DOUBLE ELSE 0.35::DOUBLE END AS confidence, CASE WHEN known AND (bull + bear > 0 OR spec >= 6) THEN 'medium' ELSE 'low' END AS evidence_quality,
    CASE WHEN known THEN least(2 + bull + bear + spec // 2, 10) ELSE 0 END::INTEGER AS depth_score, CASE WHEN known THEN least(hyped * 3, 10) ELSE 0 END::INTEGER AS hype_score FROM c1),
c3 AS (SELECT *, known AND (depth_score >= 7 OR spec >= 7) AS needs_deeper_analysis,
    CASE WHEN NOT known THEN 'fallback classifier, unknown ticker/company' ELSE 'fallback classifier' || CASE WHEN hyped > 0 THEN ', pump language' ELSE '' END
        || CASE WHEN evidence_quality = 'low' THEN ', no evidence' ELSE '' END || CASE WHEN contains(low, 'next tesla') THEN ', comparison hype' ELSE '' END END AS red_flags,
    CASE WHEN known AND bull > 0 THEN 'Post argues for improving fundamentals, upside, or business momentum.' ELSE '' END AS bull_case,
    CASE WHEN known AND bear > 0 THEN 'Post points to downside risk, dilution, or execution concerns.' ELSE '' END AS bear_case FROM c2)"""
_ALIAS = " || ".join(
    f"CASE WHEN regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_]){a}($|[^\\p{{L}}\\p{{N}}_])') THEN ',{t}' ELSE '' END" for a, t in Q.ALIASES.items()
)
_TOKENS = "regexp_extract_all(text, '[\\p{L}\\p{N}_]+')"
_ENTITY = f"""docs AS (SELECT doc_id, {_TOKENS} AS w, list_filter({_WORDS}, lambda x: regexp_full_match(x, '[A-Z]{{2,5}}')) AS marks, regexp_extract_all(text, '\\$([A-Z]{{1,5}})\\b', 1) AS cash, chr(1) || regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_ ]', chr(1), 'g') || chr(1) AS low FROM documents),
    rows AS (SELECT doc_id AS line, upper(replace(w[1], 'ß', 'ss')) AS ticker, array_to_string(w[2:3], ' ') AS company_name, coalesce(w[4], '') AS a1, array_to_string(w[5:7], ' ') AS a2 FROM docs WHERE len(w) > 0),
    one AS (SELECT ticker, min(line) AS line, max_by((company_name, a1, a2), line) AS r FROM rows GROUP BY 1),
    each AS (SELECT ticker, r[1] AS company_name, line, n, lower([r[1], r[2], r[3]][n + 1]) AS alias FROM one, (SELECT unnest([0, 1, 2]) AS n)),
    al AS (SELECT alias, min((line, n)) AS place, max_by((ticker, company_name), (line, n)) AS r FROM each WHERE alias <> '' GROUP BY 1),
    hits AS (SELECT doc_id, r[1] AS ticker, r[2] AS company_name, 2 AS how, 0 AS seen, place FROM docs JOIN al ON contains(low, alias)
        AND (contains(low, ' ' || alias || ' ') OR contains(low, chr(1) || alias || ' ') OR contains(low, ' ' || alias || chr(1)) OR contains(low, chr(1) || alias || chr(1)))
        UNION ALL SELECT doc_id, ticker, r[1], how, seen, (0, 0) FROM (SELECT doc_id, unnest(marks) AS ticker, generate_subscripts(marks, 1) AS seen, 1 AS how FROM docs UNION ALL SELECT doc_id, unnest(cash), generate_subscripts(cash, 1), 0 FROM docs) JOIN one USING (ticker)
        WHERE ticker NOT IN ({", ".join(repr(x) for x in sorted(lex.AMBIGUOUS_SYMBOLS))})),
    firsts AS (SELECT doc_id, ticker, min((how, seen, place)) AS pos, arg_min(company_name, (how, seen, place)) AS company_name FROM hits GROUP BY ALL)"""
_FLAT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"

_RUNS = """runs AS (SELECT wk, 'run_' || CAST(wk AS VARCHAR) AS analysis_run_id, CASE WHEN ((wk - DATE '2024-01-01') // 7) % 5 = 4 THEN 'failed' ELSE 'completed' END AS status,
    CASE WHEN ((wk - DATE '2024-01-01') // 7) % 4 = 2 THEN 'discovery' ELSE 'measurement' END AS run_type, ((wk - DATE '2024-01-01') // 7) % 7 <> 6 AS canonical,
    run_type = 'measurement' AND canonical AS measured, string_agg(DISTINCT substr(source_name, 2), ',' ORDER BY substr(source_name, 2)) AS source_set FROM m GROUP BY wk)"""


def _ring(catalog: str, n: int) -> str:
    """CTE ``sample``: the tickers after each signal on the ring of SHA-1."""
    return f"""ring AS (SELECT ticker AS bt, sha1(ticker) AS h, row_number() OVER (ORDER BY sha1(ticker), ticker) - 1 AS place, count(*) OVER () AS size FROM (SELECT DISTINCT ticker FROM {catalog} WHERE ticker <> '')),
    entered AS (SELECT signal_id, ticker, count(h) AS before FROM sig LEFT JOIN ring ON h < sha1(signal_id) GROUP BY ALL),
    arc AS (SELECT signal_id, ticker, before, unnest(range(least({n} + 1, (SELECT max(size) FROM ring)))) AS step FROM entered),
    sample AS (SELECT signal_id, ticker, bt AS benchmark_ticker, row_number() OVER (PARTITION BY signal_id ORDER BY step) AS sample_index FROM arc JOIN ring ON place = (before + step) % size WHERE bt <> ticker QUALIFY sample_index <= {n})"""


ORACLES: dict[str, str] = {
    "symbol_extract": f"WITH {_D} SELECT item_id, array_to_string(symbols, ',') AS symbols FROM d2",
    "alias_extract": f"SELECT doc_id AS item_id, substr({_ALIAS}, 2) AS tickers FROM documents",
    "entity_extract": f"""WITH {_ENTITY}, g AS (SELECT doc_id, string_agg(ticker, ',' ORDER BY pos) AS tickers, string_agg(coalesce(nullif(company_name, ''), 'Unknown'), ',' ORDER BY pos) AS company_names FROM firsts GROUP BY 1)
        SELECT doc_id AS item_id, coalesce(tickers, '') AS tickers, coalesce(company_names, '') AS company_names FROM documents LEFT JOIN g USING (doc_id)""",
    "json_tables": """WITH e AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN '{}' WHEN event_id % 10 = 0 THEN substr(props, 1, length(props) - 1) ELSE props END AS p FROM events)
        SELECT event_id, CASE WHEN json_valid(p) THEN CAST(json_extract_string(p, '$.k') AS BIGINT) END AS k, CASE WHEN NOT json_valid(p) THEN p END AS unparsed,
            '{"event_id":' || event_id || ',"props_json":' || CASE WHEN json_valid(p) THEN CAST(json(p) AS VARCHAR) ELSE CAST(to_json(p) AS VARCHAR) END || ',"score":' || CASE WHEN event_id % 7 = 0 THEN 'null' ELSE (event_id % 4) || '.0' END || '}' AS row FROM e""",
    "value_labels": """WITH o AS (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN 'XYZ' ELSE upper(trim(lower(substr(o_orderpriority, 3, 3)))) END AS symbol, CASE WHEN o_orderkey % 9 > 0 THEN (o_orderkey % 2000 + 0.25) / 100000 END AS p FROM orders)
        SELECT o_orderkey, CASE WHEN symbol = 'SQ' THEN 'XYZ' ELSE symbol END AS symbol, CASE WHEN p IS NULL THEN 'n/a' WHEN p < 0.001 THEN '<0.001' ELSE printf('%.3f', p) END AS p,
            CASE WHEN o_orderkey % 9 = 0 THEN 'n/a' ELSE printf('%+d', o_custkey % 100 - 50) END AS delta FROM o""",
    "first_cells": f"WITH {_M} SELECT ticker, " + ", ".join(f"arg_min(alpha, item_id) FILTER (source_name = 's{i}') AS s{i}" for i in range(5)) + " FROM m GROUP BY 1",
    "table_counts": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in ("orders", "lineitem", "events", "documents", "pages", "conversations", "labels", "embeddings")),
    "item_features": f"""WITH {_D} SELECT item_id, length(text) AS text_length, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS word_count,
        regexp_matches(low, 'https?://|www\\.') AS contains_link, regexp_matches(text, '[0-9]') AS contains_numbers, {_hits(Q.FINANCE)} > 0 AS contains_financial_terms,
        substr(sha1(author), 1, 12) AS author_hash FROM d""",
    "claim_specificity": f"WITH {_D} SELECT item_id, {_SPEC}::BIGINT AS claim_specificity_score FROM d",
    "fallback_classify": f"WITH {_CLASS} SELECT item_id, sentiment, confidence, evidence_quality, depth_score, hype_score, needs_deeper_analysis, red_flags, bull_case, bear_case FROM c3",
    "alpha_score": f"""WITH {_CLASS}, a AS (SELECT *, {_hits(Q.HYPE)} AS hh, {_hits(Q.FINANCE)} AS sh, {_hits(Q.BEARISH)} AS rh, {_hits(("clown",))} AS nh FROM c3),
        a1 AS (SELECT *, least(greatest(score, 0), 250) / 25 + depth_score * 2.5::DOUBLE + CASE evidence_quality WHEN 'medium' THEN 15 ELSE 5 END + confidence * 10 + spec * 3.2::DOUBLE + least(sh * 3, 12)
            + CASE WHEN rh > 0 OR bear_case <> '' THEN 6 ELSE 0 END - (hype_score * 4 + least(hh * 8, 32) + least((length(red_flags) - length(replace(red_flags, ', ', ' ')) + 1) * 5, 20) + least(nh * 12, 24)) AS x FROM a),
        a2 AS (SELECT *, CASE WHEN hh >= 2 AND sh = 0 THEN least(x, 35) ELSE x END AS y FROM a1),
        a3 AS (SELECT *, round(greatest(least(CASE WHEN nh > 0 AND rh = 0 THEN least(y, 25) ELSE y END, 100), 0), 2) AS alpha_signal_score FROM a2)
        SELECT item_id, alpha_signal_score, round(greatest(least(alpha_signal_score - hype_score * 4.5::DOUBLE - 1.5::DOUBLE, 100), 0), 2) AS hype_adjusted_signal_score FROM a3""",
    "mention_explode": f"""WITH {_CLASS} SELECT item_id, unnest(symbols) AS ticker, 'Unknown' AS company_name, substr(sha1(author), 1, 12) AS author_hash,
        CASE sentiment WHEN 'bullish' THEN 1 WHEN 'bearish' THEN -1 WHEN 'neutral' THEN 0 END::DOUBLE AS sentiment_numeric,
        CASE evidence_quality WHEN 'medium' THEN 2 ELSE 1 END::INTEGER AS evidence_quality_numeric, length(text) AS text_length, DATE '2024-01-01' AS time_bucket FROM c3""",
    "html_to_text": """SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(
        regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?i)</p\\s*>', chr(10), 'g'), '<[^>]+>', ' ', 'g'),
        '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&#x27;', ''''), '&apos;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM pages""",
    "json_extract": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "excerpt": f"SELECT doc_id AS item_id, CASE WHEN length({_FLAT}) <= 60 THEN {_FLAT} ELSE rtrim(substr({_FLAT}, 1, 57)) || '...' END AS excerpt FROM documents",
    "claims": """WITH c AS (SELECT *, lower(coalesce(text, '')) AS low FROM conversations), f AS (SELECT *, list_filter([
            CASE WHEN contains(low, 'revenue') THEN 'Verify the revenue claim against recent company filings.' END,
            CASE WHEN contains(low, 'margin') THEN 'Check whether the margin claim is supported by reported results.' END,
            CASE WHEN contains(low, 'guidance') THEN 'Confirm management guidance in the latest earnings materials.' END,
            CASE WHEN contains(low, 'contract') OR contains(low, 'customer') THEN 'Validate customer or contract claims using company disclosures.' END], lambda x: x IS NOT NULL) AS cl,
            list_filter([CASE WHEN contains(low, 'dilution') THEN 'Dilution risk' END, CASE WHEN contains(low, 'execution') THEN 'Execution risk' END, CASE WHEN contains(low, 'capex') THEN 'Capital intensity' END,
            CASE WHEN contains(low, 'liquidity') THEN 'Liquidity risk' END, CASE WHEN contains(low, 'customer concentration') THEN 'Customer concentration' END, CASE WHEN contains(low, 'margin') THEN 'Margin pressure' END], lambda x: x IS NOT NULL) AS ri FROM c)
        SELECT conv_id, turn, role, CASE WHEN len(cl) > 0 THEN array_to_string(cl[1:3], '|') WHEN low <> '' THEN 'Check the core thesis against filings, transcripts, or reliable reporting.' ELSE '' END AS claims,
            array_to_string(ri[1:4], '|') AS risks, array_to_string(list_filter([CASE WHEN contains(low, 'contract') OR contains(low, 'customer') THEN 'Customer or contract wins' END,
            CASE WHEN contains(low, 'guidance') OR contains(low, 'earnings') THEN 'Upcoming earnings or guidance updates' END, CASE WHEN contains(low, 'launch') OR contains(low, 'product') THEN 'Product or launch execution milestones' END], lambda x: x IS NOT NULL), '|') AS catalysts FROM f""",
    "mention_dedupe": f"""WITH {_M} SELECT thread_id AS item_id, ticker, company_name, item_id AS seq FROM m
        QUALIFY row_number() OVER (PARTITION BY thread_id, ticker ORDER BY company_name = 'Unknown', item_id) = 1""",
    "ticker_summary": f"WITH {_M}, {_summary('ticker, company_name')} SELECT * FROM summary",
    "time_buckets": f"""WITH {_M}, t AS (SELECT ticker, company_name, wk, {_COUNTS}, {_MEANS}, count(DISTINCT source_name) AS n_source, count(DISTINCT subreddit) AS n_sub,
            count(DISTINCT author_hash) AS unique_authors, count(DISTINCT thread_id) AS unique_threads FROM m GROUP BY ALL),
        t1 AS (SELECT *, coalesce(lag(total_mentions) OVER (PARTITION BY ticker, company_name ORDER BY wk), 0) AS pn FROM t),
        t2 AS (SELECT *, {_growth("total_mentions", "pn")} AS mention_growth_rate, pn = 0 AS new_ticker_detected, total_mentions - pn AS mention_change, n_source AS unique_sources,
            {_DIVERSITY} AS source_diversity_score, {_PENALTY} AS mega_popularity_penalty, {_LMHS} AS low_mentions_high_signal FROM t1),
        t3 AS (SELECT *, {_accel("total_mentions", "pn", "mention_growth_rate", "unique_authors", "unique_threads", "average_hype_score", "repetition_score", "new_ticker_detected")} AS acceleration_score FROM t2)
        SELECT * EXCLUDE (wk, n_source, n_sub, pn, mention_change, unique_sources, mega_popularity_penalty, repetition_score), wk AS bucket_start, wk + 6 AS bucket_end, {_EMERGING} AS emerging_ticker_score FROM t3""",
    "run_summary": f"""WITH {_M}, {_summary('ticker')}, i AS (SELECT item_id, arg_max(sentiment, confidence) AS sentiment, arg_max(depth, confidence) AS depth FROM m GROUP BY 1),
        tm AS (SELECT * FROM summary ORDER BY emerging_ticker_score DESC, ticker LIMIT 5), ta AS (SELECT * FROM summary ORDER BY acceleration_score DESC, ticker LIMIT 5)
        SELECT count(*) AS items_analyzed, count(*) FILTER (sentiment = 'bullish') AS bullish_items, count(*) FILTER (sentiment = 'bearish') AS bearish_items,
            count(*) FILTER (sentiment = 'neutral') AS neutral_items, count(*) FILTER (sentiment = 'irrelevant') AS irrelevant_items, count(*) FILTER (depth >= 7) AS high_depth_posts_found,
            (SELECT count(*) FROM m) AS ticker_mentions, (SELECT count(DISTINCT ticker) FROM m) AS tickers_found,
            (SELECT count(*) FILTER (low_mentions_high_signal) FROM summary) AS low_mentions_high_signal_count, (SELECT count(*) FILTER (new_ticker_detected) FROM summary) AS newly_detected_tickers_count,
            (SELECT string_agg(ticker || ':' || total_mentions, ',' ORDER BY emerging_ticker_score DESC, ticker) FROM tm) AS top_mentioned_tickers,
            (SELECT string_agg(ticker || ':' || mentions_this_period, ',' ORDER BY acceleration_score DESC, ticker) FROM ta) AS top_accelerating_tickers FROM i""",
    "flag_backjoin": f"WITH {_M}, {_summary('ticker')} SELECT item_id, ticker, source_diversity_score, controversy_score, low_mentions_high_signal, new_ticker_detected FROM m JOIN summary USING (ticker)",
    "corpus_dedupe": f"WITH {_M} SELECT thread_id AS item_id, ticker, item_id AS mention_id FROM m QUALIFY row_number() OVER (PARTITION BY thread_id, ticker ORDER BY wk DESC, created_time DESC, confidence DESC) = 1",
    "company_mode": f"""WITH {_M}, n AS (SELECT ticker, company_name, count(*) AS n FROM m GROUP BY ALL),
        u AS (SELECT ticker, company_name FROM n QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY company_name = 'Unknown', n DESC, company_name) = 1)
        SELECT ticker, u.company_name, count(*) AS n FROM m JOIN u USING (ticker) GROUP BY ALL""",
    "review_balanced": f"WITH {_M} SELECT item_id, ticker, alpha AS alpha_signal_score FROM m WHERE hype <= 10",
    "review_high_signal": f"WITH {_M} SELECT item_id, ticker, alpha AS alpha_signal_score FROM m WHERE sentiment <> 'irrelevant' AND confidence >= 0.45 AND depth >= 4 AND alpha >= 65 AND hype < 7 AND NOT (quality = 'low' AND claim <= 3)",
    "review_low_hype_leads": f"WITH {_M} SELECT item_id, ticker, alpha AS alpha_signal_score FROM m WHERE sentiment <> 'irrelevant' AND confidence >= 0.35 AND alpha >= 55 AND hype <= 4 AND NOT (quality = 'low' AND claim <= 3) AND lmhs",
    "review_new_tickers": f"WITH {_M} SELECT item_id, ticker, alpha AS alpha_signal_score FROM m WHERE is_new",
    "review_needs_verification": f"WITH {_M} SELECT item_id, ticker, alpha AS alpha_signal_score FROM m WHERE sentiment <> 'irrelevant' AND deeper",
    "trailing_window": f"""WITH {_M}, x AS (SELECT *, max(created_time) OVER (PARTITION BY ticker) AS latest FROM m)
        SELECT ticker, count(*) AS mentions, min(created_date) AS first_day FROM x WHERE created_time >= latest - INTERVAL 7 DAY GROUP BY 1""",
    "quick_search": "SELECT doc_id AS item_id, source AS source_name FROM documents WHERE contains(lower(concat_ws(' ', source, text)), 'licensed under')",
    "thread_summary": f"""WITH {_M}, s AS (SELECT thread_id, sentiment FROM (SELECT thread_id, sentiment, count(*) AS n FROM m GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY n DESC, sentiment) = 1)
        SELECT thread_id, count(*) AS mentions, count(DISTINCT author_hash) AS unique_authors, round(avg(alpha), 2) AS average_alpha, max(alpha) AS best_alpha,
            arg_max(item_id, (alpha, item_id)) AS best_item, string_agg(DISTINCT ticker, ', ' ORDER BY ticker) AS tickers, any_value(s.sentiment) AS usual_sentiment FROM m JOIN s USING (thread_id) GROUP BY 1""",
    "representative_sample": f"""WITH {_M}, r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY alpha DESC, confidence DESC, item_id) AS q1,
            row_number() OVER (PARTITION BY ticker ORDER BY created_time DESC, item_id) AS q2, row_number() OVER (PARTITION BY ticker, sentiment ORDER BY alpha DESC, confidence DESC, item_id) AS qs,
            row_number() OVER (PARTITION BY ticker, hype >= 7 ORDER BY hype DESC, item_id) AS q5 FROM m),
        p AS (SELECT *, CASE WHEN q1 <= 4 THEN q1 WHEN q2 <= 3 THEN 100 + q2 WHEN sentiment = 'bullish' AND qs <= 2 THEN 200 + qs WHEN sentiment = 'bearish' AND qs <= 2 THEN 300 + qs
            WHEN hype >= 7 AND q5 <= 2 THEN 400 + q5 ELSE 1000 + q1 END AS stage FROM r)
        SELECT ticker, item_id, row_number() OVER (PARTITION BY ticker ORDER BY stage, item_id) AS place FROM p QUALIFY place <= 10""",
    "spike_notes": f"""WITH {_M}, b AS (SELECT ticker, company_name, wk AS time_bucket, count(*) AS total_mentions, arg_max(item_id, (alpha, item_id)) AS driver_item, max(alpha) AS driver_alpha FROM m GROUP BY ALL)
        SELECT * FROM b ORDER BY total_mentions DESC, time_bucket, ticker, company_name LIMIT 5""",
    "trust_label": f"""WITH {_M} SELECT CASE WHEN mode = 'fallback' THEN 'Fallback' WHEN confidence >= 0.7 AND quality <> 'low' AND hype <= 6 THEN 'Strong' WHEN confidence < 0.35 OR quality = 'low' THEN 'Review' ELSE 'Standard' END AS trust,
        count(*) AS n FROM m GROUP BY 1""",
    "watchlist_semi": f"WITH {_M}, {_RUNS} SELECT ticker, count(*) AS mentions FROM m WHERE wk IN (SELECT wk FROM runs WHERE status = 'completed' AND measured) AND ticker IN (SELECT ticker FROM m WHERE source_name = 's0' AND sentiment = 'bullish' AND depth >= 9) GROUP BY 1",
    "new_items": f"WITH {_M} SELECT item_id, ticker FROM m WHERE wk >= DATE '2024-01-15'",
    "union_dedupe": f"""WITH {_M}, u AS (SELECT thread_id, ticker, item_id, item_type AS kind FROM m)
        SELECT thread_id, ticker, item_id, kind FROM u QUALIFY row_number() OVER (PARTITION BY thread_id, ticker ORDER BY kind = 'comment', item_id) = 1""",
    "wide_pivot": f"WITH {_M} SELECT ticker, " + ", ".join(f"round(avg(alpha) FILTER (source_name = 's{i}'), 4) AS s{i}" for i in range(5)) + " FROM m GROUP BY 1",
    "unpivot_pair": f"WITH {_M} SELECT item_id, 'hype_score' AS variable, hype::DOUBLE AS value FROM m UNION ALL SELECT item_id, 'alpha_signal_score', alpha FROM m",
    "histogram": f"WITH {_M} SELECT least(floor(alpha / 5), 19)::BIGINT AS bin, count(*) AS n FROM m GROUP BY 1",
    "run_compare": f"""WITH {_M}, a AS (SELECT ticker, count(*) AS mentions, round(avg(hype), 2) AS hype FROM m WHERE wk = DATE '2024-01-08' GROUP BY 1),
        b AS (SELECT ticker, count(*) AS mentions, round(avg(hype), 2) AS hype FROM m WHERE wk = DATE '2024-01-01' GROUP BY 1)
        SELECT ticker, coalesce(a.mentions, 0) AS mentions_now, coalesce(b.mentions, 0) AS mentions_before, coalesce(a.mentions, 0) - coalesce(b.mentions, 0) AS mentions_delta,
            coalesce(a.hype, 0) AS hype_now, coalesce(b.hype, 0) AS hype_before, coalesce(a.hype, 0) - coalesce(b.hype, 0) AS hype_delta FROM a FULL JOIN b USING (ticker)""",
    "dense_grid": f"""WITH {_M}, b AS (SELECT ticker || '/' || source_name || '/' || subreddit AS ticker, wk AS time_bucket, count(*) AS mentions FROM m GROUP BY ALL)
        SELECT ticker, time_bucket, coalesce(mentions, 0) AS mentions FROM (SELECT DISTINCT ticker FROM b) CROSS JOIN (SELECT DISTINCT time_bucket FROM b) LEFT JOIN b USING (ticker, time_bucket)""",
    "consensus": f"""WITH {_M}, c AS (SELECT ticker, count(*) AS mentions, count(*) FILTER (sentiment = 'bullish') AS bull, count(*) FILTER (sentiment = 'bearish') AS bear, avg(hype) AS hype, avg(quality_n) AS evidence, bool_or(mode = 'fallback') AS fb, max(created_time) AS newest,
            sum(CAST('0x' || substr(sha1(item_id || '|' || sentiment || '|' || alpha), 1, 15) AS BIGINT)) AS total FROM m GROUP BY 1),
        cl AS (SELECT DISTINCT ticker, sentiment, unnest([item_type || ' in ' || subreddit, item_type || ' of ' || source_name]) AS claim FROM m),
        ca AS (SELECT ticker, string_agg(claim, '|' ORDER BY claim) FILTER (sentiment = 'bullish') AS bull_case, string_agg(claim, '|' ORDER BY claim) FILTER (sentiment = 'bearish') AS bear_case
            FROM (SELECT * FROM cl WHERE sentiment IN ('bullish', 'bearish') QUALIFY row_number() OVER (PARTITION BY ticker, sentiment ORDER BY claim) <= 5) GROUP BY 1)
        SELECT ticker, substr(sha1(ticker || '|' || mentions || '|' || epoch_us(newest) || '|' || total), 1, 20) AS signature, coalesce(bull_case, '') AS bull_case, coalesce(bear_case, '') AS bear_case, mentions, round(evidence, 4) AS evidence, CASE WHEN mentions >= 8 AND evidence >= 5 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN bull + bear = 0 THEN 'neutral' WHEN bull > bear * 1.35 THEN 'bullish' WHEN bear > bull * 1.35 THEN 'bearish' ELSE 'mixed' END AS stance,
            array_to_string(list_filter([CASE WHEN mentions < 3 THEN 'thin ticker evidence' END, CASE WHEN hype >= 6 THEN 'elevated hype language' END, CASE WHEN fb THEN 'some fallback-classified evidence' END], lambda x: x IS NOT NULL), ', ') AS flags FROM c LEFT JOIN ca USING (ticker)""",
    "corpus_reset": f"""WITH {_M}, {_summary('ticker')} SELECT ticker, round(greatest(least(emerging_ticker_score - acceleration_score * 0.45::DOUBLE, 100), 0), 2) AS emerging_ticker_score,
        0::DOUBLE AS acceleration_score, 'Corpus evidence' AS trend_reliability FROM summary""",
    "source_set_hash": "SELECT n_regionkey, substr(sha1(string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey)), 1, 16) AS hash FROM nation GROUP BY 1",
    "upsert_merge": "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN round(o_totalprice + 1, 2) ELSE o_totalprice END AS o_totalprice FROM orders",
    "status_counts": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1",
}

_COV = f"""{_M}, c0 AS (SELECT wk, source_name, count(*) FILTER (item_type = 'post') AS posts_returned, count(*) FILTER (item_type = 'comment') AS comments_returned, count(DISTINCT thread_id) AS unique_threads,
    count(DISTINCT author_hash) AS unique_authors, greatest(epoch_us(min(created_time)) - epoch_us(min(wk)::TIMESTAMP), 0) / 1e6::DOUBLE / (7 * 86400) AS missed FROM m GROUP BY ALL),
cov AS (SELECT *, 'run_' || CAST(wk AS VARCHAR) AS analysis_run_id, posts_returned >= 120 AS hit_post_cap, source_name = 's1' AND ((wk - DATE '2024-01-01') // 7) % 2 = 1 AS feed_capped,
    round(CASE WHEN source_name = 's3' THEN 0.65::DOUBLE ELSE 1 END * CASE WHEN source_name = 's4' THEN 0.7::DOUBLE ELSE 1 END * CASE WHEN source_name = 's2' AND ((wk - DATE '2024-01-01') // 7) % 2 = 1 THEN 0.2::DOUBLE ELSE 1 END
        * CASE WHEN source_name = 's1' AND ((wk - DATE '2024-01-01') // 7) % 2 = 1 THEN 0.45::DOUBLE ELSE 1 END * CASE WHEN posts_returned >= 120 THEN 0.75::DOUBLE ELSE 1 END * CASE WHEN posts_returned = 0 THEN 0 WHEN posts_returned < 10 THEN 0.55::DOUBLE WHEN posts_returned < 30 THEN 0.78::DOUBLE ELSE 1 END
        * CASE WHEN missed > 0.35 THEN 0.75::DOUBLE ELSE 1 END, 3) AS coverage_reliability FROM c0)"""
_RS = """rs AS (SELECT 'run_' || CAST(wk AS VARCHAR) AS analysis_run_id, ticker, count(*) AS total_mentions, count(DISTINCT thread_id) AS unique_threads, count(DISTINCT author_hash) AS unique_authors,
    round(avg(hype), 2) AS average_hype_score, round(avg(rep), 2) AS repetition_score, round(avg(sentiment_numeric), 4) AS net_sentiment_score, round(avg(depth) * 5, 2) AS acceleration_score,
    round(avg(alpha), 2) AS emerging_ticker_score FROM m GROUP BY ALL)"""
_REASONS = """list_filter([CASE WHEN source_name = 's3' THEN 'Discovery or comment-inclusive run; useful for evidence, weaker for acceleration.' END, CASE WHEN source_name = 's4' THEN 'Single-thread source; not a broad subreddit sample.' END,
    CASE WHEN source_name = 's2' AND ((wk - DATE '2024-01-01') // 7) % 2 = 1 THEN 'Reddit rate limit affected collection.' END, CASE WHEN feed_capped THEN 'RSS cap was hit before the requested window was fully visible.' END,
    CASE WHEN hit_post_cap THEN 'Configured post cap stopped collection before the feed was exhausted.' END,
    CASE WHEN posts_returned = 0 THEN 'No posts returned for this source.' WHEN posts_returned < 10 THEN 'Very small post sample.' WHEN posts_returned < 30 THEN 'Post sample is below the preferred 30-post trend minimum.' END,
    CASE WHEN missed > 0.35 THEN 'Oldest returned post does not cover much of the requested window.' END, CASE WHEN NOT (source_name IN ('s3', 's4') OR (source_name = 's2' AND ((wk - DATE '2024-01-01') // 7) % 2 = 1) OR feed_capped OR hit_post_cap OR posts_returned < 30 OR missed > 0.35) THEN 'Comparable posts-only source sample.' END], lambda x: x IS NOT NULL)"""
_BG = lambda c, p: f"CASE WHEN coalesce({p}, 0) <= 0 THEN CASE WHEN {c} > 0 THEN least({c} / 0.25::DOUBLE, 4) ELSE 0 END ELSE greatest(least(({c} - {p}) / {p}, 4), -1) END"
ORACLES |= {
    "coverage_rows": f"""WITH {_COV} SELECT analysis_run_id, source_name, posts_returned, comments_returned, unique_threads, unique_authors, hit_post_cap, coverage_reliability,
        CASE WHEN coverage_reliability >= 0.8 THEN 'High' WHEN coverage_reliability >= 0.5 THEN 'Medium' ELSE 'Low' END AS reliability_label FROM cov""",
    "coverage_weighted": f"""WITH {_COV}, why AS (SELECT analysis_run_id, unnest(reasons) AS reason, source_name, generate_subscripts(reasons, 1) AS n FROM (SELECT *, {_REASONS} AS reasons FROM cov)),
        whys AS (SELECT analysis_run_id, array_to_string(list(reason ORDER BY place)[1:5], '; ') AS reasons FROM (SELECT analysis_run_id, reason, min((source_name, n)) AS place FROM why GROUP BY ALL) GROUP BY 1)
        SELECT * FROM whys JOIN (SELECT analysis_run_id, count(*) AS sources, sum(posts_returned)::BIGINT AS posts, sum(unique_threads)::BIGINT AS threads, sum(unique_authors)::BIGINT AS authors,
        count(*) FILTER (hit_post_cap) AS capped_sources, count(*) FILTER (feed_capped) AS feed_capped_sources, round(sum(coverage_reliability * greatest(posts_returned, 1)) / sum(greatest(posts_returned, 1)), 3) AS coverage_reliability FROM cov GROUP BY 1) USING (analysis_run_id)""",
    "rate_growth": f"""WITH {_COV}, {_RUNS}, {_RS}, cs AS (SELECT analysis_run_id, sum(posts_returned) AS posts, sum(unique_threads) AS th, sum(unique_authors) AS au, count(*) FILTER (feed_capped) AS fc,
            round(sum(coverage_reliability * greatest(posts_returned, 1)) / sum(greatest(posts_returned, 1)), 3) AS rel FROM cov GROUP BY 1),
        why AS (SELECT analysis_run_id, unnest(reasons) AS reason, source_name, generate_subscripts(reasons, 1) AS n FROM (SELECT *, {_REASONS} AS reasons FROM cov)),
        whys AS (SELECT analysis_run_id, list(reason ORDER BY place) AS reasons FROM (SELECT analysis_run_id, reason, min((source_name, n)) AS place FROM why GROUP BY ALL) GROUP BY 1),
        done AS (SELECT * FROM runs WHERE status = 'completed'), rp AS (SELECT r.*, (SELECT max_by(analysis_run_id, wk) FROM done p WHERE p.wk < r.wk AND p.source_set = r.source_set AND p.measured) AS prev FROM done r),
        q AS (SELECT rs.*, posts, fc, rel, round(total_mentions / greatest(posts, 1) * 100, 3) AS nr, round(unique_threads / greatest(th, posts, 1) * 100, 3) AS tr, round(unique_authors / greatest(au, 1) * 100, 3) AS ar FROM rs JOIN cs USING (analysis_run_id)),
        j AS (SELECT a.*, rp.measured, rp.prev, pc.posts AS pposts, pc.fc AS pfc, least(a.rel, pc.rel) AS lrel, b.ticker IS NOT NULL AS known, coalesce(b.nr, 0) AS pnr, coalesce(b.tr, 0) AS ptr, coalesce(b.ar, 0) AS par
            FROM q a JOIN rp USING (analysis_run_id) LEFT JOIN cs pc ON pc.analysis_run_id = rp.prev LEFT JOIN q b ON b.analysis_run_id = rp.prev AND b.ticker = a.ticker),
        k AS (SELECT *, coalesce(pposts, 0) < 30 OR posts < 30 AS small, measured AND prev IS NOT NULL AS fits FROM j), l AS (SELECT *, CASE WHEN small THEN coalesce(least(lrel, 0.3::DOUBLE), 0.3::DOUBLE) ELSE lrel END AS re FROM k),
        s AS (SELECT *, CASE WHEN fits THEN round(greatest(least(greatest(least(({_BG("nr", "pnr")} * 0.45::DOUBLE + {_BG("tr", "ptr")} * 0.3::DOUBLE + {_BG("ar", "par")} * 0.25::DOUBLE) * 35, 100), 0) * re
            * greatest(0.45::DOUBLE, 1 - greatest(average_hype_score - 4, 0) * 0.07::DOUBLE) * greatest(0.55::DOUBLE, 1 - repetition_score * 0.04::DOUBLE), 100), 0), 2) ELSE 0 END AS score FROM l)
        SELECT analysis_run_id, ticker, nr AS mention_rate, tr AS thread_rate, ar AS author_rate, pnr AS previous_mention_rate, score::DOUBLE AS coverage_adjusted_acceleration_score,
            CASE WHEN NOT measured THEN 'Discovery' WHEN prev IS NULL THEN 'Needs baseline' WHEN re >= 0.8 THEN 'High' WHEN re >= 0.5 THEN 'Medium' ELSE 'Low' END AS trend_reliability,
            CASE WHEN NOT measured THEN 'Discovery scrape is excluded from proper acceleration; use it for ticker discovery and evidence review.' WHEN prev IS NULL THEN 'No previous measurement scrape exists for this exact source set yet.'
                ELSE array_to_string(list_filter(list_concat(w.reasons[1:2], [CASE WHEN small THEN 'Current or previous measurement sample is below 30 posts.' END, CASE WHEN NOT known THEN 'Ticker was not present in the previous matched measurement run.' END,
                    CASE WHEN pfc > 0 THEN 'Previous measurement had at least one RSS-capped source.' END, CASE WHEN fc > 0 THEN 'Current measurement had at least one RSS-capped source.' END]), lambda x: x IS NOT NULL)[1:4], '; ') END AS trend_reliability_reason,
            score::DOUBLE AS acceleration_score, CASE WHEN fits THEN round(re, 3) ELSE rel END AS coverage_reliability,
            round(greatest(least(emerging_ticker_score - acceleration_score * 0.45::DOUBLE + score * 0.45::DOUBLE, 100), 0), 2) AS emerging_ticker_score FROM s LEFT JOIN whys w USING (analysis_run_id)""",
    "previous_run": """WITH k0 AS (SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY ALL), k AS (SELECT * FROM k0 QUALIFY n * 5 > sum(n) OVER (PARTITION BY day)), r AS (SELECT day, string_agg(event_type, ',' ORDER BY event_type) AS s FROM k GROUP BY 1)
        SELECT CAST(a.day AS VARCHAR) AS run_id, CAST(max(b.day) AS VARCHAR) AS previous_run_id FROM r a LEFT JOIN r b ON a.s = b.s AND b.day < a.day GROUP BY a.day""",
    "source_health": f"""WITH {_COV}, a AS (SELECT source_name, count(*) AS mentions, count(DISTINCT ticker) AS tickers FROM m WHERE wk = DATE '2024-01-08' GROUP BY 1)
        SELECT s.source_name, coalesce(posts_returned, 0) AS posts_returned, coalesce(comments_returned, 0) AS comments_returned, coverage_reliability, coalesce(mentions, 0) AS mentions, coalesce(tickers, 0) AS tickers,
            CASE WHEN coverage_reliability IS NULL THEN 'No scrape' WHEN posts_returned + comments_returned = 0 THEN 'No items' WHEN coalesce(tickers, 0) = 0 THEN 'No tickers' ELSE 'Active' END AS status
        FROM (SELECT 's' || n_nationkey AS source_name FROM nation) s LEFT JOIN (SELECT * FROM cov WHERE wk = DATE '2024-01-08') c USING (source_name) LEFT JOIN a USING (source_name)""",
}

_BARS = """bars AS (SELECT upper(event_type) AS ticker, ts::DATE AS date, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close,
    count(*)::DOUBLE AS volume FROM events GROUP BY ALL)"""
_LONG = """lb AS (SELECT p_brand AS ticker, l_shipdate::DATE AS date, round(max(l_extendedprice), 2) AS high, round(min(l_extendedprice), 2) AS low, arg_min(l_extendedprice, (l_orderkey, l_linenumber)) AS open,
    arg_max(l_extendedprice, (l_orderkey, l_linenumber)) AS close, sum(l_quantity) AS volume FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""
_PROBES = "probes AS (SELECT o_orderkey AS probe, 'Brand#' || (1 + o_orderkey % 5) || (1 + (o_orderkey // 5) % 5) AS ticker, o_orderdate::DATE AS day FROM orders)"
_EVENTS = """sig AS (SELECT 'signal_' || event_id AS signal_id, upper(event_type) AS ticker, ts AS signal_time, ts::DATE AS signal_day, ((event_id * 37) % 1000) / 10 AS strength FROM events)"""
_W = "WINDOW w AS (PARTITION BY ticker ORDER BY date)"


def _ahead(k: int, name: str) -> str:
    a = f"lead(close, {k}) OVER w"
    return f"""CASE WHEN {a} IS NOT NULL THEN round({a} / close - 1, 6) END AS raw_return_{name}, CASE WHEN {a} IS NOT NULL THEN CASE WHEN {a} > close THEN 1 ELSE 0 END END::DOUBLE AS price_direction_{name},
        CASE WHEN {a} IS NOT NULL THEN round(lead(volume, {k}) OVER w / volume - 1, 6) END AS volume_change_{name},
        CASE WHEN {a} IS NOT NULL THEN round(min(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND {k} FOLLOWING) / close - 1, 6) END AS drawdown_{name}"""


def _calendar(events: str, key: str, day: str, prices: str, horizons) -> str:
    """CTE ``cal``: closes as of the day and so many days later, by ASOF joins."""
    joins = "".join(f" ASOF LEFT JOIN {prices} p{h} ON e.ticker = p{h}.ticker AND e.{day} + {h} <= p{h}.date" for h in (0, *horizons))
    return f"cal AS (SELECT e.{key}, e.ticker, e.{day}, " + ", ".join(f"round(p{h}.close / p0.close - 1, 6) AS return_{h}d" for h in horizons) + f" FROM {events} e{joins})"


def _paths(events: str, key: str, day: str, prices: str, ns) -> str:
    cols = ", ".join(
        f"max(p.close) FILTER (p.date <= e.{day} + {n}) AS max_close_{n}d, min(p.close) FILTER (p.date <= e.{day} + {n}) AS min_close_{n}d, "
        f"max(p.volume) FILTER (p.date > e.{day} AND p.date <= e.{day} + {n}) AS max_volume_{n}d, round(avg(p.volume) FILTER (p.date > e.{day} AND p.date <= e.{day} + {n}), 4) AS mean_volume_{n}d"
        for n in ns
    )
    return f"paths AS (SELECT e.{key}, e.ticker, e.{day}, {cols} FROM {events} e LEFT JOIN {prices} p ON e.ticker = p.ticker AND p.date >= e.{day} AND p.date <= e.{day} + {max(ns)} GROUP BY ALL)"


ORACLES |= {
    "daily_bars": f"WITH {_BARS} SELECT * FROM bars",
    "long_bars": f"WITH {_LONG} SELECT * FROM lb",
    "asof_forward": f"WITH {_LONG}, {_PROBES} SELECT probe, e.ticker, day, p.date AS price_date, p.close FROM probes e ASOF LEFT JOIN lb p ON e.ticker = p.ticker AND e.day <= p.date",
    "asof_calendar": f"WITH {_LONG}, {_PROBES}, {_calendar('probes', 'probe', 'day', 'lb', (1, 3, 7, 14, 30))} SELECT * FROM cal",
    "horizon_outcomes": f"""WITH {_BARS}, r AS (SELECT *, close / lag(close) OVER w - 1 AS ret, row_number() OVER w AS n FROM bars {_W})
        SELECT ticker, date, round(close / open - 1, 6) AS raw_return_same_day, round(lead(open) OVER w / close - 1, 6) AS gap_return_1d,
            round(close / CASE WHEN n > 5 THEN lag(close, 5) OVER w ELSE first_value(close) OVER w END - 1, 6) AS prior_return_5d,
            round(stddev_samp(ret) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS prior_volatility_10d,
            {_ahead(1, "1d")}, {_ahead(5, "5d")}, {_ahead(21, "1m")},
            CASE WHEN lead(close, 5) OVER w IS NOT NULL THEN round(stddev_samp(ret) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), 6) END AS volatility_5d FROM r {_W}""",
    "volume_baseline": f"WITH {_LONG} SELECT ticker, date, round(avg(volume) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 6) AS baseline_volume FROM lb",
    "path_metrics": f"WITH {_LONG}, {_PROBES}, {_paths('probes', 'probe', 'day', 'lb', (7, 14, 30))} SELECT * FROM paths",
    "fetch_plan": f"""WITH {_LONG}, {_PROBES}, p AS (SELECT ticker, min(day) - 60 AS first_day, max(day) + 45 AS last_day FROM probes GROUP BY 1), h AS (SELECT ticker, min(date) AS a, max(date) AS b FROM lb GROUP BY 1)
        SELECT ticker, first_day, last_day, coalesce(a <= first_day AND b >= least(last_day, DATE '2001-09-01'), false) AS sufficient FROM p LEFT JOIN h USING (ticker)""",
    "price_placeholders": f"""WITH {_LONG}, {_PROBES}, u AS (SELECT ticker, date, false AS missing FROM lb UNION ALL SELECT DISTINCT ticker, day, true FROM probes WHERE (ticker, day) NOT IN (SELECT (ticker, date) FROM lb))
        SELECT ticker, count(*) AS rows, count(*) FILTER (missing) AS missing FROM u GROUP BY 1""",
    "top_evidence": f"WITH {_M} SELECT ticker, item_id, row_number() OVER (PARTITION BY ticker ORDER BY alpha DESC, confidence DESC, created_time DESC, item_id) AS place FROM m QUALIFY place <= 3",
    "signal_gate": f"""WITH {_M}, {_summary('ticker')}, mm AS (SELECT ticker, count(*) FILTER (mode <> 'fallback') AS mo FROM m GROUP BY 1),
        r AS (SELECT *, row_number() OVER (ORDER BY emerging_ticker_score DESC, average_alpha_signal_score DESC, ticker) AS signal_rank FROM summary JOIN mm USING (ticker))
        SELECT ticker, signal_rank, signal_rank <= 5 OR emerging_ticker_score >= 60 OR acceleration_score >= 20 AS score_gate, total_mentions >= 3 AND unique_authors >= 2 AND unique_threads >= 2 AND mo >= 1 AS quality_gate,
            (ticker IN ('VI1', 'CL2') OR ((signal_rank <= 5 OR emerging_ticker_score >= 60 OR acceleration_score >= 20) AND total_mentions >= 3 AND unique_authors >= 2 AND unique_threads >= 2 AND mo >= 1)) AND total_mentions >= 20 AS freezes,
            round(emerging_ticker_score * 0.55::DOUBLE + acceleration_score * 0.25::DOUBLE + average_alpha_signal_score * 0.2::DOUBLE - average_hype_score * 0.1::DOUBLE, 4) AS strength FROM r""",
    "cooldown_fold": f"""WITH RECURSIVE {_EVENTS}, o AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY signal_time, signal_id) AS n FROM sig),
        f AS (SELECT ticker, n, signal_id, true AS ok, signal_time AS t, strength AS s FROM o WHERE n = 1
            UNION ALL SELECT o.ticker, o.n, o.signal_id, o.signal_time - f.t > INTERVAL 24 HOUR OR o.strength >= f.s + 12,
                CASE WHEN o.signal_time - f.t > INTERVAL 24 HOUR OR o.strength >= f.s + 12 THEN o.signal_time ELSE f.t END, CASE WHEN o.signal_time - f.t > INTERVAL 24 HOUR OR o.strength >= f.s + 12 THEN o.strength ELSE f.s END
            FROM f JOIN o ON o.ticker = f.ticker AND o.n = f.n + 1)
        SELECT ticker, signal_id FROM f WHERE ok""",
    "random_benchmark": f"""WITH {_LONG}, {_EVENTS}, u AS (SELECT DISTINCT ticker AS bt FROM lb WHERE ticker <> ''), s AS (SELECT DISTINCT signal_id, ticker FROM sig)
        SELECT signal_id, ticker, bt AS benchmark_ticker, row_number() OVER (PARTITION BY signal_id, ticker ORDER BY sha1(signal_id || bt), bt) AS sample_index FROM s JOIN u ON bt <> coalesce(ticker, '') QUALIFY sample_index <= 12""",
    "benchmark_means": f"""WITH {_BARS}, {_EVENTS}, {_ring("bars", 3)}, p AS (SELECT ticker AS benchmark_ticker, round(avg(close), 4) AS r FROM bars GROUP BY 1)
        SELECT signal_id, count(*) AS benchmark_count, round(avg(r), 6) AS benchmark_r FROM sample JOIN p USING (benchmark_ticker) GROUP BY 1""",
    "signal_review": f"WITH {_EVENTS} SELECT ticker, CASE WHEN bool_or(strength < 60) THEN 'Needs validation' ELSE 'Validated' END AS status, count(*) AS signals FROM sig GROUP BY 1",
}


def _buckets(name: str, start: str, min_mentions: int = 2, keys: str = "ticker", source: str = "m", run: bool = False) -> str:
    return f"""{name}0 AS (SELECT {keys}, {start} AS bucket_start, {"analysis_run_id, " if run else ""}count(*) AS mentions, count(*) FILTER (item_type = 'post') AS post_count, count(*) FILTER (item_type = 'comment') AS comment_count,
        count(DISTINCT subreddit) AS unique_subreddit_count, count(DISTINCT author_hash) AS unique_author_count, count(DISTINCT thread_id) AS unique_thread_count, round(avg(hype), 4) AS average_hype_score,
        round(avg(quality_n), 4) AS average_evidence_score, round(avg(claim), 4) AS average_specificity_score, coalesce(round(avg(sentiment_numeric), 4), 0) AS average_sentiment_score,
        round(avg(alpha), 4) AS average_alpha_signal_score, count(*) FILTER (sentiment = 'bullish') AS bullish_mention_count, count(*) FILTER (sentiment = 'bearish') AS bearish_mention_count,
        max(lmhs::INTEGER) AS low_mentions_high_signal_flag FROM {source} GROUP BY ALL),
    {name}1 AS (SELECT *, round(mentions / sum(mentions) OVER (PARTITION BY bucket_start) * 100, 4) AS mention_share_of_voice, round((bullish_mention_count + 0.5::DOUBLE) / (bearish_mention_count + 0.5::DOUBLE), 4) AS bull_bear_ratio,
        lag(mentions) OVER w AS pm, lag(average_sentiment_score) OVER w AS ps FROM {name}0 WINDOW w AS (PARTITION BY ticker ORDER BY bucket_start)),
    {name} AS (SELECT * EXCLUDE (pm, ps), coalesce(mentions - pm, 0) AS mention_acceleration, CASE WHEN pm > 0 THEN round((mentions - pm) / pm * 100, 6) END AS percentage_mention_acceleration,
        coalesce(round(abs(average_sentiment_score - ps), 6), 0) AS narrative_shift_score FROM {name}1 WHERE mentions >= {min_mentions})"""


for _name, _start in (("daily", "created_date"), ("weekly", "wk"), ("monthly", "CAST(date_trunc('month', created_time) AS DATE)")):
    ORACLES[f"signal_buckets_{_name}"] = f"WITH {_M}, {_buckets('q', _start)} SELECT * FROM q"
ORACLES["signal_buckets_run"] = f"WITH {_M}, mr AS (SELECT *, 'run_' || CAST(wk AS VARCHAR) AS analysis_run_id FROM m), {_buckets('q', 'wk', source='mr', run=True)} SELECT * FROM q"

_H = {"1d": 1, "3d": 3, "5d": 5, "10d": 10, "20d": 20, "1m": 21}
_SET = f"""{_M}, {_BARS}, mk AS (SELECT * EXCLUDE (ticker), kind AS ticker FROM m), {_buckets("q", "created_date", 1, source="mk")},
ret AS (SELECT ticker, date, close, round(close / open - 1, 6) AS raw_return_same_day, {", ".join(f"round(lead(close, {k}) OVER w / close - 1, 6) AS raw_return_{h}" for h, k in _H.items())} FROM bars {_W}),
ds0 AS (SELECT q.*, p.date AS price_date, p.* EXCLUDE (ticker, date), b.raw_return_5d AS market_return_5d FROM q ASOF LEFT JOIN ret p ON q.ticker = p.ticker AND q.bucket_start <= p.date
    LEFT JOIN (SELECT d.bucket_start, r.raw_return_5d FROM (SELECT DISTINCT bucket_start FROM q) d ASOF LEFT JOIN (SELECT * FROM ret WHERE ticker = 'VIEW') r ON d.bucket_start <= r.date) b ON b.bucket_start = q.bucket_start),
ds AS (SELECT *, close IS NOT NULL AS price_available, round(raw_return_5d - market_return_5d, 6) AS abnormal_return_5d FROM ds0)"""


def _pairs(signals, outcomes) -> str:
    return "pairs AS (" + " UNION ALL ".join(f"SELECT '{s}' AS signal, '{o}' AS outcome, {s}::DOUBLE AS x, {o}::DOUBLE AS y FROM ds" for s in signals for o in outcomes) + ")"


_R = "CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END"
_ERFC = "((((({0} * 1.061405429::DOUBLE + -1.453152027::DOUBLE * 1) * {0}) + 1.421413741::DOUBLE) * {0} - 0.284496736::DOUBLE) * {0} + 0.254829592::DOUBLE) * {0}"
_DESCRIBE = f"""z AS (SELECT *, CASE WHEN sample_size >= 3 AND abs(r) < 1 THEN abs(r * sqrt((sample_size - 2) / greatest(1 - r * r, 1e-12))) / sqrt(2) END AS zz FROM grid), z2 AS (SELECT *, 1 / (1 + zz * 0.3275911::DOUBLE) AS t FROM z)
SELECT signal, outcome, sample_size, missing_count, round(r, 6) AS correlation, round(({_ERFC.format('t')}) * exp(-zz * zz), 5) AS p_value,
    CASE WHEN sample_size > 3 AND abs(r) < 1 THEN round(tanh(atanh(r) - 1.96::DOUBLE / sqrt(sample_size - 3)), 5) END AS ci_low, CASE WHEN sample_size > 3 AND abs(r) < 1 THEN round(tanh(atanh(r) + 1.96::DOUBLE / sqrt(sample_size - 3)), 5) END AS ci_high,
    CASE WHEN sample_size < 20 THEN 'Unreliable' WHEN sample_size < 50 THEN 'Weak evidence' WHEN sample_size < 100 THEN 'Moderate evidence' ELSE 'Stronger evidence' END AS reliability,
    CASE WHEN r IS NULL THEN 'no complete relationship' WHEN abs(round(r, 6)) < 0.1 THEN 'negligible' WHEN abs(round(r, 6)) < 0.3 THEN 'weak' WHEN abs(round(r, 6)) < 0.5 THEN 'moderate' ELSE 'strong' END AS effect FROM z2"""
_GRID = f"""grid AS (SELECT signal, outcome, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS sample_size, count(*) FILTER (x IS NULL OR y IS NULL) AS missing_count,
    {_R.replace("(x, y)", "(CASE WHEN y IS NOT NULL THEN x END, CASE WHEN x IS NOT NULL THEN y END)").replace("pop(x)", "pop(CASE WHEN y IS NOT NULL THEN x END)").replace("pop(y)", "pop(CASE WHEN x IS NOT NULL THEN y END)")} AS r FROM pairs GROUP BY ALL)"""
_SPEAR = f"""ok AS (SELECT * FROM pairs WHERE x IS NOT NULL AND y IS NOT NULL), rk AS (SELECT signal, outcome, rank() OVER (PARTITION BY signal, outcome ORDER BY x) + (count(*) OVER (PARTITION BY signal, outcome, x) - 1) / 2 AS x,
    rank() OVER (PARTITION BY signal, outcome ORDER BY y) + (count(*) OVER (PARTITION BY signal, outcome, y) - 1) / 2 AS y FROM ok),
grid AS (SELECT signal, outcome, n AS sample_size, missing AS missing_count, r FROM (SELECT signal, outcome, count(*) AS n, {_R} AS r FROM rk GROUP BY ALL)
    JOIN (SELECT signal, outcome, count(*) FILTER (x IS NULL OR y IS NULL) AS missing FROM pairs GROUP BY ALL) USING (signal, outcome))"""
_KENDALL = """ok AS (SELECT *, row_number() OVER () AS i FROM pairs WHERE x IS NOT NULL AND y IS NOT NULL),
g0 AS (SELECT a.signal, a.outcome, sum(sign((b.x - a.x) * (b.y - a.y))) AS s, count(*) FILTER (a.x <> b.x) AS nx, count(*) FILTER (a.y <> b.y) AS ny FROM ok a JOIN ok b ON a.signal = b.signal AND a.outcome = b.outcome AND a.i < b.i GROUP BY ALL),
grid AS (SELECT signal, outcome, n AS sample_size, missing AS missing_count, s / sqrt(nx::DOUBLE * ny::DOUBLE) AS r FROM g0 JOIN (SELECT signal, outcome, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS n,
    count(*) FILTER (x IS NULL OR y IS NULL) AS missing FROM pairs GROUP BY ALL) USING (signal, outcome))"""
_PAIRS = _pairs(Q.GRID_SIGNALS, Q.GRID_OUTCOMES)
_Z = lambda c: f"CASE WHEN stddev_samp({c}) OVER () > 0 THEN round(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER (), 5) ELSE 0 END AS {c}_z"
ORACLES |= {
    "correlation_dataset": f"WITH {_SET} SELECT ticker, bucket_start, mentions, price_date, price_available, raw_return_1d, raw_return_5d, abnormal_return_5d, market_return_5d FROM ds",
    "dataset_diagnostics": f"""WITH {_SET} SELECT count(*) AS bucket_rows, count(DISTINCT ticker) AS ticker_count, count(*) FILTER (price_available) AS price_available_rows, count(*) FILTER (NOT price_available) AS missing_price_rows,
        round(count(*) FILTER (price_available) / count(*), 4) AS completeness, min(bucket_start) AS date_start, max(bucket_start) AS date_end FROM ds""",
    "pearson_grid": f"WITH {_SET}, {_PAIRS}, {_GRID}, {_DESCRIBE}",
    "spearman_grid": f"WITH {_SET}, {_PAIRS}, {_SPEAR}, {_DESCRIBE}",
    "kendall_tau_b": f"WITH {_SET}, {_PAIRS}, {_KENDALL}, " + _DESCRIBE.replace("r * sqrt((sample_size - 2) / greatest(1 - r * r, 1e-12))", "r * sqrt(9 * sample_size * (sample_size - 1) / (2 * (2 * sample_size + 5)))"),
    "lead_lag": f"WITH {_SET}, {_pairs(['mentions'], [f'raw_return_{h}' for h in ('same_day', *_H)])}, {_GRID}, {_DESCRIBE}",
    "interesting_rank": f"""WITH {_SET}, {_PAIRS}, {_GRID}, d AS ({"WITH " + _DESCRIBE})
        SELECT signal, outcome, round(round(abs(coalesce(correlation, 0)) * 0.52::DOUBLE + CASE WHEN p_value < 0.05 THEN 0.12::DOUBLE ELSE 0 END + CASE WHEN sample_size >= 50 THEN 0.2::DOUBLE ELSE 0 END + 0.08::DOUBLE
            + CASE WHEN outcome LIKE '%abnormal_return%' THEN 0.08::DOUBLE ELSE 0 END - missing_count / (sample_size + missing_count) * 0.2::DOUBLE, 6), 4) AS interesting_score, row_number() OVER (ORDER BY interesting_score DESC, signal, outcome) AS place FROM d WHERE sample_size >= 20""",
    "rolling_corr": f"""WITH {_SET}, r AS (SELECT ticker, bucket_start, mentions AS x, raw_return_1d AS y FROM ds WHERE raw_return_1d IS NOT NULL),
        s AS (SELECT ticker, bucket_start, count(*) OVER w AS rows_in_window, covar_pop(x, y) OVER w AS c, stddev_pop(x) OVER w AS sx, stddev_pop(y) OVER w AS sy FROM r WINDOW w AS (ORDER BY bucket_start, ticker ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))
        SELECT ticker, bucket_start, rows_in_window, CASE WHEN rows_in_window >= 8 AND sx * sy > 0 THEN round(c / (sx * sy), 5) END AS rolling_correlation FROM s""",
    **{f"rolling_{m}{'_by_ticker' if by else ''}": f"""WITH {_SET}, r AS (SELECT ticker, bucket_start, mentions AS x, raw_return_1d AS y, row_number() OVER ({by} ORDER BY bucket_start, ticker) AS i FROM ds WHERE raw_return_1d IS NOT NULL),
        pairs AS (SELECT e.ticker, e.bucket_start, e.i, a.i AS ai, sign(a.x - b.x) AS sx, sign(a.y - b.y) AS sy FROM r e JOIN r a ON {on.format("a")} a.i BETWEEN e.i - 13 AND e.i JOIN r b ON {on.format("b")} b.i BETWEEN e.i - 13 AND e.i),
        t AS ({body}) SELECT ticker, bucket_start, least(i, 14) AS rows_in_window, CASE WHEN i >= 8 AND bottom > 0 THEN round(top / sqrt(bottom), 5) END AS rolling_correlation FROM t"""
        for m, body in (
            ("kendall", "SELECT ticker, bucket_start, i, sum(sx * sy) AS top, sum(abs(sx)) * sum(abs(sy)) AS bottom FROM pairs GROUP BY ALL"),
            ("spearman", "SELECT ticker, bucket_start, i, sum(rx * ry) AS top, sum(rx * rx) * sum(ry * ry) AS bottom FROM (SELECT ticker, bucket_start, i, ai, sum(sx) AS rx, sum(sy) AS ry FROM pairs GROUP BY ALL) GROUP BY ALL"),
        ) for by, on in (("", ""), ("PARTITION BY ticker", "{0}.ticker = e.ticker AND"))},
    "rolling_corr_by_ticker": f"""WITH {_SET}, r AS (SELECT ticker, bucket_start, mentions AS x, raw_return_1d AS y FROM ds WHERE raw_return_1d IS NOT NULL),
        s AS (SELECT ticker, bucket_start, count(*) OVER w AS rows_in_window, covar_pop(x, y) OVER w AS c, stddev_pop(x) OVER w AS sx, stddev_pop(y) OVER w AS sy FROM r WINDOW w AS (PARTITION BY ticker ORDER BY bucket_start ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))
        SELECT ticker, bucket_start, rows_in_window, CASE WHEN rows_in_window >= 8 AND sx * sy > 0 THEN round(c / (sx * sy), 5) END AS rolling_correlation FROM s""",
    "descriptive_stats": f"""WITH {_SET}, u AS (SELECT 'mentions' AS variable, mentions::DOUBLE AS v FROM ds UNION ALL SELECT 'average_hype_score', average_hype_score FROM ds UNION ALL SELECT 'raw_return_5d', raw_return_5d FROM ds)
        SELECT variable, count(v) AS valid_n, count(*) - count(v) AS missing, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS sd, round(median(v), 4) AS median, round(min(v), 4) AS minimum, round(max(v), 4) AS maximum,
            round(skewness(v), 3) AS skewness, round(kurtosis(v), 3) AS kurtosis FROM u GROUP BY 1""",
    "zscore_overlay": f"WITH {_SET}, d AS (SELECT bucket_start, avg(mentions) AS x, avg(raw_return_1d) AS y FROM ds GROUP BY 1) SELECT bucket_start, {_Z('x')}, coalesce({_Z('y').removesuffix(' AS y_z')}, 0) AS y_z FROM d",
    "ols_several": f"""WITH {_SET}, p AS (SELECT mentions::DOUBLE AS a, average_hype_score AS b, raw_return_5d AS y FROM ds WHERE raw_return_5d IS NOT NULL AND average_hype_score IS NOT NULL),
        s AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_, var_pop(y) AS yy FROM p),
        c AS (SELECT *, aa * bb - ab * ab AS det, (ay * bb - by_ * ab) / det AS ka, (by_ * aa - ay * ab) / det AS kb FROM s), f AS (SELECT *, my - ka * ma - kb * mb AS k, (yy - ka * ay - kb * by_) AS rss, n * rss / (n - 3) AS s2 FROM c),
        t AS (SELECT 'intercept' AS term, k AS coefficient, sqrt(s2 / n * (1 + (ma * ma * bb - 2 * ma * mb * ab + mb * mb * aa) / det)) AS se, * FROM f UNION ALL SELECT 'mentions', ka, sqrt(s2 / n * bb / det), * FROM f UNION ALL SELECT 'average_hype_score', kb, sqrt(s2 / n * aa / det), * FROM f)
        SELECT term, round(coefficient, 5) AS coefficient, round(se, 5) AS standard_error, round(1 - rss / yy, 6) AS r_squared, n FROM t""",
    "ols_coefficients": f"""WITH {_SET}, p AS (SELECT mentions::DOUBLE AS x, raw_return_5d AS y FROM ds WHERE raw_return_5d IS NOT NULL),
        a AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) AS c, var_pop(x) AS vx, var_pop(y) AS vy FROM p), b AS (SELECT *, c / vx AS slope, my - c / vx * mx AS intercept, n * (vy - c * c / vx) / (n - 2) AS s2 FROM a)
        SELECT n, round(intercept, 6) AS intercept, round(sqrt(s2 * (1 / n + mx * mx / (n * vx))), 6) AS intercept_se, round(slope, 6) AS slope, round(sqrt(s2 / (n * vx)), 6) AS slope_se, round(c * c / (vx * vy), 6) AS r_squared FROM b""",
}


_HISTORY = f"{_M}, {_RUNS}, {_RS}, h AS (SELECT rs.*, wk, run_type, measured, source_set FROM rs JOIN runs USING (analysis_run_id) WHERE status = 'completed')"
_SIGNED = lambda c, n: f"CASE WHEN round({c}, {n}) > 0 THEN '+' ELSE '' END || printf('%.{n}f', round({c}, {n}) + 0::DOUBLE)"
_CLAIMS = """[CASE WHEN contains(low, 'revenue') THEN 'Verify the revenue claim against recent company filings.' END,
    CASE WHEN contains(low, 'margin') THEN 'Check whether the margin claim is supported by reported results.' END,
    CASE WHEN contains(low, 'guidance') THEN 'Confirm management guidance in the latest earnings materials.' END,
    CASE WHEN contains(low, 'contract') OR contains(low, 'customer') THEN 'Validate customer or contract claims using company disclosures.' END]"""
# the corpus: threads as items, the mention of the newest completed run
_CORPUS = _M.replace("m AS (", "m0 AS (", 1) + f""", {_RUNS.replace("FROM m GROUP", "FROM m0 GROUP")},
    raw AS (SELECT m0.* EXCLUDE (item_id, mode), thread_id AS item_id, coalesce(min(CASE WHEN depth >= 2 THEN CASE WHEN mode = 'model' THEN 'ollama' ELSE 'fallback' END END) OVER (PARTITION BY wk, thread_id), 'unknown') AS mode FROM m0 JOIN runs USING (wk) WHERE status = 'completed'),
    first AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY item_id, ticker ORDER BY wk DESC, created_time DESC, confidence DESC) = 1),
    names AS (SELECT ticker, company_name FROM (SELECT ticker, company_name, count(*) AS n FROM first GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY company_name = 'Unknown', n DESC, company_name) = 1),
    m AS (SELECT first.* REPLACE (names.company_name AS company_name) FROM first JOIN names USING (ticker)), {_summary("ticker, company_name", "full_summary")},
    summary AS (SELECT * REPLACE (round(greatest(least(emerging_ticker_score - acceleration_score * 0.45::DOUBLE, 100), 0), 2) AS emerging_ticker_score, 0::DOUBLE AS acceleration_score) FROM full_summary)"""
def _scoped(n: int) -> str:
    seen = f"created_time <= signal_time + INTERVAL {n} DAY"
    return f"count(created_time) FILTER ({seen}) AS mentions_{n}d, " + ", ".join(f"count(DISTINCT {c}) FILTER ({seen}) AS {k}_{n}d" for k, c in (("threads", "thread_id"), ("authors", "author_hash"), ("sources", "source_name")))


_WINDOWS = (7, 14, 30)
_MEET = "x.created_time > p.signal_time AND (p.runs = 0 OR (x.done > p.signal_time AND x.done <= p.signal_time + INTERVAL 30 DAY))"
#: Every event meets the mentions of its scope: those of its later measurement runs, or all.
_ATTENTION = f"""{_COV}, {_EVENTS}, {_RUNS}, cs AS (SELECT wk, round(sum(coverage_reliability * greatest(posts_returned, 1)) / sum(greatest(posts_returned, 1)), 3) AS rel FROM cov GROUP BY 1),
    r AS (SELECT wk, wk::TIMESTAMP + INTERVAL 6 DAY AS done, coalesce(rel, 0) AS rel FROM runs LEFT JOIN cs USING (wk) WHERE status = 'completed' AND measured),
    p AS (SELECT signal_id, ticker, signal_time, count(done) AS runs, round(avg(rel), 9) AS c FROM sig LEFT JOIN r ON done > signal_time AND done <= signal_time + INTERVAL 30 DAY GROUP BY ALL),
    x AS (SELECT m.*, done FROM m LEFT JOIN r USING (wk)),
    own AS (SELECT signal_id, p.ticker, runs, c, {", ".join(_scoped(n) for n in _WINDOWS)}, count(DISTINCT thread_id) AS threads_later, count(DISTINCT source_name) AS sources_later
        FROM p LEFT JOIN x ON x.kind = p.ticker AND {_MEET} GROUP BY ALL),
    un AS (SELECT signal_id, {", ".join(f"count(created_time) FILTER (created_time <= signal_time + INTERVAL {n} DAY) AS universe_{n}d" for n in _WINDOWS)} FROM p LEFT JOIN x ON {_MEET} GROUP BY 1),
    sh AS (SELECT *, {", ".join(f"round(mentions_{n}d * 100 / nullif(universe_{n}d, 0), 3) AS share_{n}d" for n in _WINDOWS)} FROM own JOIN un USING (signal_id)),
    att AS (SELECT *, CASE WHEN runs > 0 THEN 'measurement' ELSE 'corpus' END AS scope, {", ".join(f"round(least(100, mentions_{n}d * 3.5::DOUBLE + threads_{n}d * 5 + authors_{n}d * 2.5::DOUBLE + sources_{n}d * 10 + coalesce(share_{n}d, 0) * 0.35::DOUBLE), 2) AS spread_{n}d" for n in _WINDOWS)},
        CASE WHEN c >= 0.8 THEN 'High' WHEN c >= 0.5 THEN 'Medium' WHEN c IS NOT NULL THEN 'Low' WHEN sources_later >= 2 AND threads_later >= 2 THEN 'Medium' ELSE 'Low' END AS attention_reliability FROM sh)"""


def _outcomes(days: str, returns: tuple, paths: tuple, spikes: tuple, abnormal: tuple = ()) -> str:
    """CTEs ``ab`` (adjusted bars) and ``facts``: what the market did from each (ticker, signal_day) of ``days`` on."""
    joins = "".join(f" ASOF LEFT JOIN ab p{h} ON e.ticker = p{h}.ticker AND e.signal_day + {h} <= p{h}.date" for h in (0, *returns))
    within = lambda n, low: f"FILTER (b.date {low} e.signal_day AND b.date <= e.signal_day + {n})"
    cols = [f"max(b.ref) {within(n, '>=')} / nullif(any_value(e.c0), 0) - 1 AS max_gain_{n}d, min(b.ref) {within(n, '>=')} / nullif(any_value(e.c0), 0) - 1 AS max_drawdown_{n}d" for n in paths]
    cols += [f"max(b.volume) {within(n, '>')} / nullif(any_value(e.base), 0) AS volume_spike_{n}d" for n in spikes] + [f"avg(b.volume) {within(n, '>')} / nullif(any_value(e.base), 0) AS abnormal_volume_{n}d" for n in abnormal]
    names = [c.rsplit(" AS ", 1)[1] for part in cols for c in part.split(", ") if " AS " in c]
    return f"""ab AS (SELECT *, coalesce(CASE WHEN volume % 3 <> 0 THEN round(close * 0.97, 4) END, close) AS ref, avg(volume) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS base FROM bars),
    f0 AS (SELECT e.ticker, e.signal_day, p0.ref AS c0, p0.base AS base, {", ".join(f"round(p{h}.ref / nullif(p0.ref, 0) - 1, 4) AS return_{h}d" for h in returns)} FROM {days} e{joins}),
    f1 AS (SELECT e.ticker, e.signal_day, {", ".join(cols)} FROM f0 e LEFT JOIN ab b ON b.ticker = e.ticker AND b.date >= e.signal_day AND b.date <= e.signal_day + 30 GROUP BY ALL),
    facts AS (SELECT ticker, signal_day, c0 AS price_at_signal, {", ".join(f"return_{h}d" for h in returns)}, {", ".join(f"round({c}, 4) AS {c}" for c in names)} FROM f0 JOIN f1 USING (ticker, signal_day))"""


_MARKET = f"""days AS (SELECT DISTINCT * FROM (SELECT ticker, signal_day FROM sig UNION ALL SELECT 'VIEW', signal_day FROM sig)), {_outcomes("days", (1, 3, 7, 14, 30), (7, 14, 30), (3, 7, 14, 30), (7, 30))},
    market AS (SELECT sig.signal_id, f.*, b.return_7d AS benchmark_return_7d, b.return_30d AS benchmark_return_30d, round(f.return_7d - b.return_7d, 4) AS excess_return_7d, round(f.return_30d - b.return_30d, 4) AS excess_return_30d
        FROM sig LEFT JOIN facts f ON f.ticker = sig.ticker AND f.signal_day = sig.signal_day LEFT JOIN facts b ON b.ticker = 'VIEW' AND b.signal_day = sig.signal_day)"""
_SAMPLED = f"""{_ring("bars", 3)}, s AS (SELECT signal_id, signal_day, benchmark_ticker, sample_index FROM sample JOIN sig USING (signal_id)),
    pairs AS (SELECT DISTINCT benchmark_ticker AS ticker, signal_day FROM s), random AS (WITH {_outcomes("pairs", (7, 30), (7,), (7, 30))} SELECT * FROM facts),
    outcomes AS (SELECT s.*, random.* EXCLUDE (ticker, signal_day) FROM s LEFT JOIN random ON random.ticker = benchmark_ticker AND random.signal_day = s.signal_day)"""
_FRAME = f"""{_ATTENTION}, {_BARS}, {_MARKET}, {_SAMPLED},
    rm AS (SELECT signal_id, count(DISTINCT benchmark_ticker) AS random_sample_size, {", ".join(f"round(avg({c}), 6) AS random_mean_{c}" for c in ("return_7d", "return_30d", "volume_spike_7d"))} FROM outcomes GROUP BY 1),
    frame AS (SELECT sig.*, CASE WHEN strength >= 80 THEN 'Useful lead' WHEN strength >= 60 THEN 'Worth deeper research' WHEN strength >= 40 THEN 'Too early' END AS label, market.return_7d, excess_return_7d, spread_14d, attention_reliability,
        random_sample_size, random_mean_return_7d, random_mean_return_30d, random_mean_volume_spike_7d FROM sig LEFT JOIN market USING (signal_id) LEFT JOIN att USING (signal_id) LEFT JOIN rm USING (signal_id))"""
_PRESETS = {"Best emerging": ("emerging_ticker_score DESC", "average_alpha_signal_score"), "Highest acceleration": ("acceleration_score DESC", "emerging_ticker_score"), "Highest alpha": ("average_alpha_signal_score DESC", "emerging_ticker_score"),
    "Lowest hype": ("average_hype_score", "average_alpha_signal_score"), "Most mentioned": ("total_mentions DESC", "emerging_ticker_score")}
_G = f"WITH {_SET}, {_PAIRS}, {_GRID}, d AS (WITH {_DESCRIBE})"
_SIDES = """sides AS (SELECT signal, a.correlation AS raw_correlation, a.p_value AS raw_p_value, a.sample_size AS raw_sample_size, b.correlation AS abnormal_correlation, b.p_value AS abnormal_p_value, b.sample_size AS abnormal_sample_size
    FROM (SELECT * FROM d WHERE outcome = 'raw_return_5d') a FULL JOIN (SELECT * FROM d WHERE outcome = 'abnormal_return_5d') b USING (signal))"""
_WORDS_OF = "regexp_extract_all(low, '[\\p{L}\\p{M}\\p{N}_]+')"
ORACLES |= {
    "repetition_score": f"""WITH d AS (SELECT doc_id AS item_id, lower(text) AS low, text FROM documents), w AS (SELECT *, {_WORDS_OF} AS w, regexp_split_to_array(text, '\\s+') AS parts FROM d)
        SELECT item_id, least(len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1] AND (i = 2 OR w[i - 1] <> w[i - 2]))) * 2 + {_hits(Q.PHRASES)} * 3
            + least(len(list_filter(parts, lambda x: length(x) > 3 AND upper(x) = x AND lower(x) <> x)), 3), 10)::BIGINT AS repetition_score FROM w""",
    "correlation_warnings": f"""WITH {_SET}, {_PAIRS}, ok AS (SELECT * FROM pairs WHERE x IS NOT NULL AND y IS NOT NULL),
        st AS (SELECT signal, outcome, count(*) AS n, count(DISTINCT x) AS dx, count(DISTINCT y) AS dy, {_R} AS r, avg(x) AS mx, nullif(stddev_samp(x), 0) AS sx, avg(y) AS my, nullif(stddev_samp(y), 0) AS sy FROM ok GROUP BY ALL),
        near AS (SELECT signal, outcome, x, y FROM ok JOIN st USING (signal, outcome) WHERE coalesce(abs((x - mx) / sx), 0) <= 3.5 AND coalesce(abs((y - my) / sy), 0) <= 3.5),
        rk AS (SELECT signal, outcome, rank() OVER (PARTITION BY signal, outcome ORDER BY x) + (count(*) OVER (PARTITION BY signal, outcome, x) - 1) / 2 AS x, rank() OVER (PARTITION BY signal, outcome ORDER BY y) + (count(*) OVER (PARTITION BY signal, outcome, y) - 1) / 2 AS y FROM near),
        tr AS (SELECT signal, outcome, count(*) AS nt, {_R} AS rt FROM rk GROUP BY ALL), mi AS (SELECT signal, outcome, count(*) FILTER (x IS NULL OR y IS NULL) AS missing FROM pairs GROUP BY ALL)
        SELECT signal, outcome, array_to_string(list_filter([CASE WHEN coalesce(n, 0) < 20 THEN 'sample size too small' END, CASE WHEN n > 0 AND missing / (n + missing) > 0.25 THEN 'many missing price values' END,
            CASE WHEN n >= 8 AND dx / n <= 0.12 THEN signal || ' has many tied values' WHEN n >= 8 AND dy / n <= 0.12 THEN outcome || ' has many tied values' END,
            CASE WHEN n >= 12 AND nt < n AND nt >= 8 AND abs(r - rt) >= 0.25 THEN 'correlation may be driven by one extreme outlier' END, CASE WHEN contains(outcome, 'same_day') THEN 'same-period relationship may be reactive rather than predictive' END,
            CASE WHEN contains(outcome, 'abnormal_return') AND abs(coalesce(r, 0)) < 0.05 THEN 'market-adjusted relationship is very weak' END, 'multiple comparisons can create false positives'], lambda x: x IS NOT NULL), '; ') AS warnings
        FROM mi LEFT JOIN st USING (signal, outcome) LEFT JOIN tr USING (signal, outcome)""",
    "cooldown_by_run": f"""WITH RECURSIVE {_EVENTS}, o AS (SELECT *, date_trunc('hour', signal_time) AS run, strength < 1 AS manual, row_number() OVER (PARTITION BY ticker ORDER BY signal_time, signal_id) AS n FROM sig),
        f AS (SELECT ticker, n, signal_id, true AS ok, signal_time AS t, strength AS s, run FROM o WHERE n = 1
            UNION ALL SELECT o.ticker, o.n, o.signal_id, o.run <> f.run AND (o.manual OR o.signal_time - f.t > INTERVAL 24 HOUR OR o.strength >= f.s + 12) AS ok2,
                CASE WHEN o.run <> f.run AND (o.manual OR o.signal_time - f.t > INTERVAL 24 HOUR OR o.strength >= f.s + 12) THEN o.signal_time ELSE f.t END,
                CASE WHEN o.run <> f.run AND (o.manual OR o.signal_time - f.t > INTERVAL 24 HOUR OR o.strength >= f.s + 12) THEN o.strength ELSE f.s END,
                CASE WHEN o.run <> f.run AND (o.manual OR o.signal_time - f.t > INTERVAL 24 HOUR OR o.strength >= f.s + 12) THEN o.run ELSE f.run END
            FROM f JOIN o ON o.ticker = f.ticker AND o.n = f.n + 1)
        SELECT ticker, signal_id FROM f WHERE ok""",
    "completed_mentions": f"""WITH {_M}, {_RUNS} SELECT item_id, ticker, analysis_run_id, run_type, canonical AS canonical_trend_run, CASE WHEN depth >= 2 THEN CASE WHEN mode = 'model' THEN 'ollama' ELSE 'fallback' END END AS classifier_mode
        FROM m JOIN runs USING (wk) WHERE status = 'completed'""",
    "historical_summaries": f"WITH {_HISTORY} SELECT ticker, analysis_run_id, total_mentions, run_type, source_set FROM h",
    "measured_history": f"WITH {_HISTORY} SELECT ticker, count(*) AS runs, sum(total_mentions)::BIGINT AS mentions FROM h WHERE measured GROUP BY 1",
    "ticker_history": f"""WITH {_HISTORY} SELECT ticker, analysis_run_id, lag(analysis_run_id) OVER (PARTITION BY ticker ORDER BY wk) AS previous_run_id, total_mentions, row_number() OVER (PARTITION BY ticker ORDER BY wk DESC) AS back
        FROM h QUALIFY back <= 3""",
    "ticker_shift": f"""WITH {_HISTORY}, c AS (SELECT ticker, count(*) OVER (PARTITION BY ticker) AS n, row_number() OVER (PARTITION BY ticker ORDER BY wk DESC) AS back, total_mentions - lag(total_mentions) OVER w AS a,
            coalesce(net_sentiment_score, 0) - coalesce(lag(net_sentiment_score) OVER w, 0) AS b, average_hype_score - lag(average_hype_score) OVER w AS c FROM h WINDOW w AS (PARTITION BY ticker ORDER BY wk))
        SELECT ticker, CASE WHEN n < 2 THEN 'Only one completed run contains this ticker, so there is no clean before/after yet.' ELSE 'Latest run moved ' || {_SIGNED("a", 0)} || ' mentions, ' || {_SIGNED("b", 2)}
            || ' net sentiment, and ' || {_SIGNED("c", 1)} || ' hype versus the previous completed run.' END AS shift FROM c WHERE back = 1""",
    "source_activity": f"""WITH {_M} SELECT 'run_' || CAST(wk AS VARCHAR) AS analysis_run_id, source_name, count(DISTINCT thread_id) AS items_analyzed, sum(per)::BIGINT AS ticker_mentions, strftime(max(created_time), '%Y-%m-%d %H:%M:%S') AS newest_item_time
        FROM (SELECT wk, thread_id, source_name, max(created_time) AS created_time, any_value(per) AS per FROM (SELECT *, count(*) OVER (PARTITION BY wk, thread_id) AS per FROM m) GROUP BY wk, thread_id, source_name) GROUP BY wk, source_name""",
    "explorer_stats": f"""WITH {_M} SELECT ticker, count(*) AS mentions, count(DISTINCT item_id) AS items, count(DISTINCT author_hash) AS authors, count(DISTINCT thread_id) AS threads, count(DISTINCT source_name) AS sources,
        count(*) FILTER (sentiment = 'bullish') AS bullish_mentions, count(*) FILTER (sentiment = 'bearish') AS bearish_mentions, count(*) FILTER (sentiment = 'neutral') AS neutral_mentions, round(avg(hype), 2) AS average_hype,
        round(avg(quality_n), 2) AS average_evidence_quality, round(avg(alpha), 2) AS average_alpha, count(*) FILTER (mode = 'fallback') AS fallback_mentions, count(*) FILTER (mode = 'ollama') AS model_mentions,
        strftime(min(created_time), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(created_time), '%Y-%m-%d %H:%M:%S') AS last_seen, 'run_' || CAST(max(wk) AS VARCHAR) AS latest_run_id FROM m GROUP BY 1""",
    "bucket_sentiment": f"""WITH {_M} SELECT ticker, company_name, wk AS bucket_start, count(*) AS total_mentions, any_value(s) AS net_sentiment_score
        FROM (SELECT *, round(avg(sentiment_numeric) OVER (PARTITION BY ticker, wk), 6) AS s FROM m) GROUP BY ALL""",
    "ticker_claims": f"""WITH {_D}, c AS (SELECT *, list_filter({_CLAIMS}, lambda x: x IS NOT NULL) AS cl FROM d2),
        u AS (SELECT DISTINCT ticker, unnest(CASE WHEN len(cl) > 0 THEN cl[1:3] WHEN low <> '' THEN ['Check the core thesis against filings, transcripts, or reliable reporting.'] ELSE [] END) AS claim FROM (SELECT *, unnest(symbols) AS ticker FROM c))
        SELECT ticker, string_agg(claim, '|' ORDER BY claim) AS claims FROM (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY claim) <= 8) GROUP BY 1""",
    "corpus_summary": f"WITH {_CORPUS} SELECT ticker, company_name, total_mentions, unique_authors, emerging_ticker_score, acceleration_score, 'Corpus evidence' AS trend_reliability, 0::DOUBLE AS coverage_reliability FROM summary",
    "corpus_counts": f"WITH {_CORPUS} SELECT count(DISTINCT item_id) AS items_collected, count(DISTINCT wk) AS runs_included, count(*) AS kept_rows, min(created_date) AS first_seen_date, max(created_date) AS most_recent_seen_date FROM m",
    "corpus_flags": f"""WITH {_CORPUS} SELECT ticker, CASE WHEN mode = 'fallback' THEN 'Fallback' WHEN confidence >= 0.7 AND quality <> 'low' AND hype <= 6 THEN 'Strong' WHEN confidence < 0.35 OR quality = 'low' THEN 'Review' ELSE 'Standard' END AS trust_status,
        summary.low_mentions_high_signal, summary.new_ticker_detected, count(*) AS n FROM m JOIN summary USING (ticker) GROUP BY ALL""",
    "benchmark_outcomes": f"WITH {_BARS}, {_EVENTS}, {_SAMPLED} SELECT * FROM outcomes",
    "market_outcomes": f"WITH {_BARS}, {_EVENTS}, {_MARKET} SELECT * FROM market",
    "attention_outcomes": f"WITH {_ATTENTION} SELECT signal_id, ticker, scope, {', '.join(f'{k}_{n}d' for n in _WINDOWS for k in ('mentions', 'threads', 'authors', 'sources', 'universe', 'share', 'spread'))} FROM att",
    "attention_reliability": f"WITH {_ATTENTION} SELECT signal_id, attention_reliability FROM att",
    "review_frame": f"""WITH {_FRAME} SELECT signal_id, ticker, label, return_7d, excess_return_7d, spread_14d, attention_reliability, random_sample_size, random_mean_return_7d, random_mean_return_30d,
        random_mean_volume_spike_7d FROM frame""",
    "review_kpis": f"""WITH {_FRAME} SELECT count(*) AS signals, count(label) AS labelled, count(*) FILTER (label IN ('Useful lead', 'Worth deeper research')) AS useful, count(return_7d) AS with_return, round(avg(return_7d), 6) AS average_return_7d,
        round(avg(spread_14d), 4) AS average_spread_14d FROM frame""",
    "signal_inbox": f"WITH {_FRAME} SELECT signal_id, spread_14d FROM frame WHERE label IS NULL AND contains(ticker, 'VIEW') ORDER BY spread_14d DESC",
    "recent_events": f"WITH {_EVENTS} SELECT ticker, signal_id, row_number() OVER (PARTITION BY ticker ORDER BY signal_time DESC, signal_id DESC) AS back FROM sig QUALIFY back <= 8",
    "summary_presets": f"WITH {_M}, {_summary('ticker')} " + " UNION ALL ".join(f"(SELECT '{k}' AS preset, row_number() OVER (ORDER BY {a}, {b} DESC, ticker) AS place, ticker FROM summary QUALIFY place <= 8)" for k, (a, b) in _PRESETS.items()),
    "summary_headline": f"""WITH {_M}, {_summary('ticker')} SELECT CASE WHEN max(acceleration_score) > 0 THEN max_by(ticker, (acceleration_score, emerging_ticker_score, ticker)) ELSE max_by(ticker, (emerging_ticker_score, average_alpha_signal_score, ticker)) END AS ticker,
        CASE WHEN max(acceleration_score) > 0 THEN max(acceleration_score) ELSE max(emerging_ticker_score) END AS value, CASE WHEN max(acceleration_score) > 0 THEN 'Top acceleration' ELSE 'Top signal' END AS label FROM summary""",
    "summary_chips": f"""WITH {_M}, {_summary('ticker')} SELECT ticker, array_to_string(list_filter([CASE WHEN total_mentions >= 20 THEN 'High' END, CASE WHEN low_mentions_high_signal THEN 'Low-hype lead' END, CASE WHEN new_ticker_detected THEN 'New ticker' END,
        CASE WHEN average_hype_score >= 7 THEN 'High hype' END], lambda x: x IS NOT NULL), '|') AS chips, ticker IN ('VI1', 'ER3') AS watched FROM summary""",
    "strongest_relationships": f"""{_G}, e AS (SELECT * FROM d WHERE correlation IS NOT NULL) SELECT * FROM ((SELECT 'positive' AS kind, signal, outcome, correlation FROM e ORDER BY correlation DESC, signal DESC, outcome DESC LIMIT 1)
        UNION ALL (SELECT 'negative', signal, outcome, correlation FROM e ORDER BY correlation, signal, outcome LIMIT 1) UNION ALL (SELECT 'absolute', signal, outcome, correlation FROM e ORDER BY abs(correlation) DESC, signal DESC, outcome DESC LIMIT 1))""",
    "correlation_heatmap": f"""{_G} SELECT signal, outcome, correlation FROM (SELECT * FROM d WHERE abs(correlation) >= 0.01 AND sample_size >= 10 ORDER BY correlation DESC, signal, outcome LIMIT 20)
        WHERE contains(outcome, 'raw_return') AND signal IN ('mentions', 'mention_share_of_voice', 'mention_acceleration', 'percentage_mention_acceleration', 'post_count', 'comment_count')""",
    "raw_or_abnormal": f"{_G}, {_SIDES} SELECT * FROM sides",
    "abnormal_reading": f"""{_G}, {_SIDES}, b AS (SELECT abs(raw_correlation) AS r, abs(abnormal_correlation) AS a FROM sides ORDER BY coalesce(abs(abs(raw_correlation) - abs(abnormal_correlation)), -1) DESC, signal DESC LIMIT 1)
        SELECT CASE WHEN r IS NULL OR a IS NULL THEN 'Some comparison cells still lack enough complete price data.'
            WHEN r > a + 0.08::DOUBLE THEN 'The raw return relationship is stronger than the abnormal return relationship, suggesting broader market movement may explain part of the result.'
            WHEN a >= r - 0.03::DOUBLE AND a >= 0.1 THEN 'The abnormal return relationship remains visible after market adjustment, so the pattern may be more ticker-specific.'
            ELSE 'No meaningful abnormal return relationship was found under the current filters.' END AS reading FROM b""",
    "rolling_reading": f"""WITH t AS (SELECT * FROM ({ORACLES["rolling_corr"]}) WHERE rolling_correlation IS NOT NULL), a AS (SELECT count(*) AS n, arg_min(rolling_correlation, (bucket_start, ticker)) AS first, arg_max(rolling_correlation, (bucket_start, ticker)) AS last,
            coalesce(stddev_samp(rolling_correlation), 0) AS s FROM t)
        SELECT n, first, last, round(s, 6) AS sd, CASE WHEN n < 3 THEN 'Rolling correlation is based on a small sample and may not be reliable.' WHEN s > 0.35 THEN 'Correlation is unstable over time, so this signal should be treated cautiously.'
            WHEN last > first + 0.12::DOUBLE THEN 'The relationship has strengthened over the selected rolling window.' WHEN last < first - 0.12::DOUBLE THEN 'The relationship was stronger earlier and has recently weakened.'
            ELSE 'The rolling relationship is broadly stable under the selected window.' END AS reading FROM a""",
    "trend_lines": f"WITH {_SET}, {_PAIRS} SELECT signal, outcome, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept FROM pairs WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL",
    "box_quartiles": f"""WITH {_SET}, u AS (SELECT 'mentions' AS variable, mentions::DOUBLE AS v FROM ds UNION ALL SELECT 'average_hype_score', average_hype_score FROM ds UNION ALL SELECT 'raw_return_5d', raw_return_5d FROM ds)
        SELECT variable, """ + ", ".join(f"round(quantile_cont(v, {q}), 6) AS {n}" for n, q in (("low", 0.0), ("q1", 0.25), ("middle", 0.5), ("q3", 0.75), ("high", 1.0))) + " FROM u GROUP BY 1",
    "evidence_labels": f"""{_G} SELECT signal, outcome, CASE WHEN p_value IS NULL THEN 'not enough complete observations for a p-value' WHEN p_value < 0.001 THEN 'very strong statistical evidence' WHEN p_value < 0.01 THEN 'strong statistical evidence'
        WHEN p_value < 0.05 THEN 'statistically significant' ELSE 'not statistically significant' END AS evidence FROM d""",
}


_FIRST_WORDS = "regexp_extract_all(text, '[\\p{L}\\p{N}_]+')"
ORACLES |= {
    "feed_window": f"""WITH {_M}, w AS (SELECT thread_id || '|' || author_hash AS item_id, source_name, thread_id, item_type, created_time FROM m WHERE created_time >= TIMESTAMP '2024-01-05' AND created_time <= TIMESTAMP '2024-01-19'),
        o AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY source_name <> 's4', source_name, created_time DESC) = 1),
        p AS (SELECT * FROM o QUALIFY item_type <> 'post' OR row_number() OVER (PARTITION BY item_type, source_name ORDER BY created_time DESC, item_id) <= 40),
        c AS (SELECT * FROM p QUALIFY item_type <> 'comment' OR row_number() OVER (PARTITION BY item_type, thread_id ORDER BY created_time DESC, item_id) <= 3)
        SELECT item_id, source_name, item_type, strftime(created_time, '%Y-%m-%d %H:%M:%S.%f') AS created FROM c""",
    "matched_sources": f"WITH {_M} SELECT item_id, CASE WHEN CAST(thread_id AS BIGINT) % 10 = 0 THEN CAST(thread_id AS BIGINT) + 1000 WHEN subreddit <> 'r2' THEN CAST(substr(subreddit, 2) AS BIGINT) END AS source_id FROM m",
    "catalog_symbols": f"WITH {_ENTITY} SELECT DISTINCT CASE WHEN ticker = 'SQ' THEN 'XYZ' ELSE ticker END AS ticker FROM rows",
    "catalog_clashes": f"WITH {_ENTITY}, a AS (SELECT ticker, unnest([lower(a1), lower(a2)]) AS alias FROM rows) SELECT alias, count(DISTINCT ticker) AS tickers FROM a WHERE alias <> '' GROUP BY 1 HAVING count(DISTINCT ticker) > 1",
    "pair_merge": f"""WITH c AS (SELECT doc_id, {_FIRST_WORDS} AS w FROM documents), u AS (SELECT doc_id, unnest([w[1], lower(w[2]), upper(replace(w[1], 'ß', 'ss')), w[2]]) AS t, unnest([CASE WHEN doc_id % 3 = 0 THEN w[3] END, '', w[5], CASE WHEN doc_id % 2 = 0 THEN w[6] ELSE '' END]) AS c, unnest([1, 2, 3, 4]) AS n FROM c WHERE len(w) >= 6),
        g AS (SELECT doc_id, upper(replace(t, 'ß', 'ss')) AS t, min(n) AS n, arg_min(c, n) FILTER (c <> '') AS c FROM u GROUP BY ALL) SELECT doc_id, string_agg(t || '=' || coalesce(c, 'Unknown'), '|' ORDER BY n) AS pairs FROM g GROUP BY 1""",
    "source_inputs": """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'thread_url' WHEN 1 THEN 'subreddit' WHEN 2 THEN 'subreddit' ELSE 'invalid' END AS kind, CASE page_id % 4 WHEN 0 THEN 'topic_' || page_id WHEN 1 THEN 'topic' || page_id ELSE '' END AS community,
        CASE page_id % 4 WHEN 0 THEN 'ab' || page_id ELSE '' END AS thread, CASE page_id % 3 WHEN 1 THEN '[deleted]' ELSE 'n' || page_id END AS author FROM pages""",
    "deeper_analysis": f"""WITH d AS (SELECT doc_id AS item_id, text, lower(text) AS low FROM documents), e AS (SELECT *, list_filter({_CLAIMS}, lambda x: x IS NOT NULL) AS cl FROM d WHERE item_id % 11 >= 7 OR item_id % 3 = 2 OR item_id % 13 = 0)
        SELECT item_id, CASE WHEN item_id % 4 = 0 THEN 'summary ' || item_id ELSE substr(text, 1, 220) END AS stronger_summary, CASE WHEN len(cl) > 0 THEN array_to_string(cl[1:3], '|') WHEN low <> '' THEN 'Check the core thesis against filings, transcripts, or reliable reporting.' ELSE '' END AS key_claims,
            array_to_string(list_filter([CASE WHEN contains(low, 'contract') OR contains(low, 'customer') THEN 'Customer or contract wins' END, CASE WHEN contains(low, 'guidance') OR contains(low, 'earnings') THEN 'Upcoming earnings or guidance updates' END,
                CASE WHEN contains(low, 'launch') OR contains(low, 'product') THEN 'Product or launch execution milestones' END], lambda x: x IS NOT NULL), '|') AS possible_catalysts,
            array_to_string(list_filter([CASE WHEN contains(low, 'dilution') THEN 'Dilution risk' END, CASE WHEN contains(low, 'execution') THEN 'Execution risk' END, CASE WHEN contains(low, 'capex') THEN 'Capital intensity' END, CASE WHEN contains(low, 'liquidity') THEN 'Liquidity risk' END,
                CASE WHEN contains(low, 'customer concentration') THEN 'Customer concentration' END, CASE WHEN contains(low, 'margin') THEN 'Margin pressure' END], lambda x: x IS NOT NULL)[1:4], '|') AS possible_risks FROM e""",
    "conformed_items": """SELECT CAST(doc_id AS VARCHAR) AS item_id, coalesce(source, '') AS source_name, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE doc_id % 90 END AS score, 'post' AS item_type, '' AS body_text, 0 AS comment_depth, NULL::VARCHAR AS author,
        CASE WHEN doc_id % 4 > 0 THEN '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') || ' 05:06:07' END AS created, 18 AS columns FROM documents WHERE doc_id % 9 > 0""",
    "insert_missing": "SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN o_totalprice ELSE o_totalprice * 2 END AS o_totalprice FROM orders",
    "json_rows": """SELECT o_orderkey, '{"o_orderkey":' || o_orderkey || ',"status":' || CASE WHEN o_orderkey % 3 > 0 THEN '"' || o_orderstatus || '"' ELSE 'null' END || ',"tags":["' || o_orderpriority || '"]}' AS line FROM orders""",
}
_SHORT = "list_filter([{}], lambda x: list_contains(symbols, x))"
ORACLES["model_answers"] = f"""WITH {_CLASS}, a AS (SELECT *, CASE WHEN item_id % 7 IN (1, 4) THEN 'good' WHEN item_id % 7 IN (2, 5) THEN 'full' ELSE 'none' END AS view, {_SPEC} AS spec0, list_filter({_CLAIMS}, lambda x: x IS NOT NULL) AS cl,
        CASE WHEN item_id % 7 IN (1, 4) THEN {_SHORT.format("'THE', 'OF'")} WHEN item_id % 7 IN (2, 5) THEN {_SHORT.format("'IN'")} ELSE symbols END AS ts FROM c3),
    b AS (SELECT *, CASE WHEN len(cl) > 0 THEN array_to_string(cl[1:3], '|') WHEN low <> '' THEN 'Check the core thesis against filings, transcripts, or reliable reporting.' ELSE '' END AS claims FROM a)
    SELECT item_id, CASE view WHEN 'none' THEN 'fallback' ELSE 'ollama' END AS classifier_mode, CASE view WHEN 'good' THEN 'bullish' WHEN 'full' THEN 'irrelevant' ELSE sentiment END AS sentiment,
        CASE view WHEN 'good' THEN 1 WHEN 'full' THEN 0 ELSE confidence END::DOUBLE AS confidence, CASE view WHEN 'good' THEN 'high' WHEN 'full' THEN 'low' ELSE evidence_quality END AS evidence_quality,
        CASE view WHEN 'good' THEN 7 WHEN 'full' THEN 0 ELSE depth_score END AS depth_score, CASE view WHEN 'good' THEN 0 WHEN 'full' THEN 10 ELSE hype_score END AS hype_score,
        CASE view WHEN 'full' THEN 3 ELSE spec0 END AS claim_specificity_score, view <> 'none' OR needs_deeper_analysis AS needs_deeper_analysis, CASE view WHEN 'none' THEN bull_case ELSE '' END AS bull_case,
        CASE view WHEN 'none' THEN bear_case WHEN 'full' THEN 'falls' ELSE '' END AS bear_case, array_to_string(ts, '|') AS tickers, array_to_string(list_transform(ts, lambda x: 'Unknown'), '|') AS company_names,
        CASE view WHEN 'good' THEN 'one flag' WHEN 'full' THEN '' ELSE replace(red_flags, ', ', '|') END AS red_flags, CASE view WHEN 'full' THEN 'a|b' ELSE claims END AS claims_to_verify FROM b"""
ORACLES |= {
    "coercions": """WITH o AS (SELECT *, substr(o_orderpriority, 1, 1) AS loose FROM orders)
        SELECT o_orderkey, loose = '1' AS flag, CASE o_orderstatus WHEN 'P' THEN 4 WHEN 'F' THEN CAST(loose AS BIGINT) ELSE 10 END::BIGINT AS score,
            CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate::DATE, '%Y-%m-%d 00:00:00') END AS at FROM o""",
    "date_bounds": f"WITH {_M} SELECT ticker, greatest(max(created_date) - 7, min(created_date)) AS start_day, max(created_date) AS end_day FROM m GROUP BY 1",
    "run_windows": f"""WITH {_M}, {_RUNS}, p AS (SELECT *, (SELECT max(q.wk) FROM runs q WHERE q.wk < r.wk AND q.status = 'completed' AND q.source_set = r.source_set) AS prev FROM runs r)
        SELECT analysis_run_id, CASE WHEN prev IS NULL THEN strftime(wk - 6, '%Y-%m-%d 00:00:00') ELSE strftime(prev::TIMESTAMP + INTERVAL 6 DAY + INTERVAL 1 SECOND, '%Y-%m-%d %H:%M:%S') END AS window_start,
            CASE WHEN prev IS NULL THEN strftime(wk, '%Y-%m-%d 23:59:59') ELSE strftime(wk, '%Y-%m-%d 00:00:00') END AS window_end FROM p""",
    "run_labels": f"""WITH {_M}, {_RUNS}, s AS (SELECT DISTINCT wk, CAST(substr(source_name, 2) AS INTEGER) AS id FROM m), n AS (SELECT wk, id, coalesce(lower(r_name), 'source:' || id) AS name FROM s LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON r_regionkey = id)
        SELECT 'run_' || CAST(wk AS VARCHAR) AS analysis_run_id, string_agg(name, ', ' ORDER BY id) AS source_names, arg_min(name, id) || CASE WHEN count(*) > 1 THEN ' +' || (count(*) - 1) ELSE '' END AS source_label FROM n GROUP BY wk""",
    "run_timeline": f"WITH {_M}, {_RUNS} SELECT analysis_run_id, wk + 6 AS day, '6d' AS period FROM runs WHERE status = 'completed' ORDER BY wk DESC LIMIT 12",
    "quality_columns": f"""WITH {_M}, q AS (SELECT *, CASE WHEN depth >= 2 THEN CASE WHEN mode = 'model' THEN 'ollama' ELSE 'fallback' END ELSE 'unknown' END AS k FROM m)
        SELECT item_id, ticker, k AS classifier_mode, CASE WHEN k = 'fallback' THEN 'Fallback' WHEN confidence >= 0.7 AND quality <> 'low' AND hype <= 6 THEN 'Strong' WHEN confidence < 0.35 OR quality = 'low' THEN 'Review' ELSE 'Standard' END AS trust_status FROM q""",
    "top_posts": f"WITH {_M} SELECT ticker, item_id, row_number() OVER (PARTITION BY ticker ORDER BY alpha DESC, confidence DESC, created_time DESC, item_id) AS place FROM m QUALIFY place <= 8",
    "market_freshness": f"""WITH {_BARS}, {_EVENTS}, {_calendar("sig", "signal_id", "signal_day", "bars", (7,))}, p AS (SELECT ticker, max(signal_day) FILTER (return_7d IS NOT NULL) AS latest, bool_or(return_7d IS NULL) AS missing FROM cal GROUP BY 1),
        a AS (SELECT *, greatest(epoch(TIMESTAMP '2024-01-26') - epoch(latest::TIMESTAMP), 0) / 3600 AS hours FROM p)
        SELECT ticker, CASE WHEN latest IS NULL THEN 'Market cache needs refresh' WHEN hours <= 24 AND NOT missing THEN 'Market cache fresh' WHEN hours <= 72 THEN 'Market cache partial' ELSE 'Market cache needs refresh' END AS status FROM a""",
    "correlation_fetch_plan": f"""WITH {_EVENTS}, e AS (SELECT ticker, signal_day FROM sig UNION ALL SELECT 'SPY', signal_day FROM sig) SELECT ticker, min(signal_day) - 20 AS first_day, max(signal_day) + 55 AS last_day FROM e GROUP BY 1""",
}


def _with_text_dates(name: str) -> str:
    """Days as text, as in the queries."""
    days = Q.DAYS.get(name, ())
    return f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in days)}) FROM ({ORACLES[name]})" if days else ORACLES[name]


def _half_up(sql: str) -> str:
    """Every ``round(x, n)`` over the shortest decimal of x.

    That is what Spark rounds; DuckDB rounds the binary value, and they part at ties such as 0.145.
    """
    at = sql.find("round(")
    if at < 0 or (at and (sql[at - 1].isalnum() or sql[at - 1] == "_")):
        return sql if at < 0 else sql[: at + 6] + _half_up(sql[at + 6 :])
    depth, comma, end = 0, -1, at + 6
    while depth >= 0:
        c = sql[end]
        depth += (c in "([") - (c in ")]")
        if c == "," and not depth:
            comma = end
        end += 1
    x, n = _half_up(sql[at + 6 : comma]), sql[comma + 1 : end - 1]
    return f"{sql[:at]}round(TRY_CAST(CAST(CAST({x} AS DOUBLE) AS VARCHAR) AS DECIMAL(38, 18)),{n})::DOUBLE{_half_up(sql[end:])}"


ORACLES = {name: _half_up(_with_text_dates(name)) for name in ORACLES}
