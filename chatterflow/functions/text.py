"""Text functions: entity symbols, hit counts, flags, HTML, authors, links, excerpts and labels (STR1-18)."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as lex

#: Characters of named entities, and of the numbers that browsers read as Windows-1252, by their hexadecimal digits.
_NAMED = {f"&{name}": text for name, text in html5.items() if name.endswith(";")}
_NUMBERED = {f"{i:X}": bytes([i]).decode("cp1252", "replace") for i in range(128, 160)}


def empty_if_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def hits(lowered: Column, terms: Iterable[str]) -> Column:
    """How many of the terms occur, as substrings (STR5)."""
    out = F.lit(0)
    for term in terms:
        out = out + F.when(lowered.contains(term), 1).otherwise(0)
    return out


def any_of(lowered: Column, terms: Iterable[str]) -> Column:
    """Whether a term occurs. Evaluation stops at the first that does."""
    out = F.lit(False)
    for term in reversed(list(terms)):
        out = F.when(lowered.contains(term), True).otherwise(out)
    return out


def has_link(text: Column) -> Column:
    return F.lower(text).rlike(r"https?://|www\.")


def has_digit(text: Column) -> Column:
    return text.rlike("[0-9]")


def word_count(text: Column) -> Column:
    """Words between white space (STR7)."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")).cast("long")


def cashtags(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)\$([A-Z]{1,5})\b"), 1)


def bare_symbols(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)\b([A-Z]{2,5})\b"), 1)


def symbols(text: Column, catalog: Iterable[str], ambiguous: Iterable[str] = lex.AMBIGUOUS_SYMBOLS) -> Column:
    """Distinct catalog symbols in a text: cashtags first, then bare ones, each in order of appearance (STR1, STR2).

    ``catalog`` is the small entity list; its symbols become one literal array.
    """
    allowed = F.array(*[F.lit(s) for s in sorted(set(catalog) - set(ambiguous))]).cast("array<string>")
    found = F.concat(cashtags(text), bare_symbols(text))
    return F.array_intersect(F.array_distinct(found), allowed)


def aliases(text: Column, lookup: Mapping[str, str]) -> Column:
    """Tickers whose alias stands in the lower-cased text between non-word characters, in catalog order (STR3, JN22)."""
    lowered = F.lower(text)
    found = [
        F.when(lowered.contains(alias) & lowered.rlike(rf"(?U)(?<!\w)\Q{alias}\E(?!\w)"), F.lit(ticker)) for alias, ticker in lookup.items()
    ]
    return F.array_distinct(F.array_compact(F.array(*found))) if found else F.array().cast("array<string>")


def unescape(text: Column) -> Column:
    """Named and numeric entities that end with a semicolon become their characters; each distinct one is replaced once.

    The ampersand's own entity comes last, so that what it uncovers isn't decoded again.
    """
    entity = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
    table = lambda of: F.from_json(F.lit(json.dumps(of)), "map<string,string>")

    def char(e: Column) -> Column:
        digits = F.regexp_extract(e, "^&#[xX]?([0-9a-fA-F]+);", 1)
        code = F.when(e.rlike("^&#[xX]"), F.conv(digits, 16, 16)).otherwise(F.conv(digits, 10, 16))
        n = F.conv(code, 16, 10).cast("long")
        odd = (n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
        number = F.when(odd, "\ufffd").when(n.between(128, 159), F.element_at(table(_NUMBERED), code)).otherwise(F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32"))
        return F.when(e.startswith("&#"), number).otherwise(F.coalesce(F.element_at(table(_NAMED), e), e))

    found = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(entity), F.lit(0))), lambda e: e != "&amp;")
    decoded = F.replace(F.aggregate(found, text, lambda kept, e: F.replace(kept, e, char(e))), F.lit("&amp;"), F.lit("&"))
    return F.when(text.contains("&"), decoded).otherwise(text)


def html_to_text(html: Column) -> Column:
    """Without comments and tags, entities decoded, white space collapsed (STR8)."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?i)</p\s*>", "\n")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(unescape(out), r"[\s\x{a0}]+", " "))


def author(name: Column) -> Column:
    """Without the profile prefix; blank becomes [deleted] (STR9)."""
    bare = F.regexp_replace(F.trim(empty_if_null(name)), r"^/?u/", "")
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit("[deleted]"))


def author_hash(name: Column) -> Column:
    """First 12 digits of the SHA-1; blank counts as [deleted] (STR10)."""
    return F.substring(F.sha1(F.coalesce(F.nullif(name, F.lit("")), F.lit("[deleted]"))), 1, 12)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def community(url: Column) -> Column:
    """Name behind /r/ in a link or source string, lower-cased; '' if there is none (STR11, STR12)."""
    return F.lower(F.regexp_extract(url, r"(?:^|/)r/([A-Za-z0-9_]+)", 1))


def thread_id(url: Column) -> Column:
    return F.regexp_extract(url, r"/comments/([A-Za-z0-9]+)", 1)


def source_kind(source: Column) -> Column:
    """thread_url, subreddit, or invalid, for what a user types as a source (STR12)."""
    bare = F.trim(source)
    return (
        F.when(thread_id(bare) != "", "thread_url")
        .when((community(bare) != "") | bare.rlike("^[A-Za-z0-9_]{2,}$"), "subreddit")
        .otherwise("invalid")
    )


def excerpt(text: Column, size: int = 180) -> Column:
    """White space collapsed, cut to ``size`` characters, the last three being dots (STR13)."""
    flat = F.trim(F.regexp_replace(empty_if_null(text), r"\s+", " "))
    return F.when(F.length(flat) <= size, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, size - 3)), F.lit("...")))


def ticker(text: Column) -> Column:
    return F.upper(F.trim(F.replace(empty_if_null(text), F.lit("$"), F.lit(""))))


def market_symbol(symbol: Column) -> Column:
    out = symbol
    for old, new in lex.MARKET_SYMBOLS.items():
        out = F.when(symbol == old, new).otherwise(out)
    return out


def _texts_if(*rules: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(test, F.lit(text)) for test, text in rules]))


def claims_to_verify(text: Column) -> Column:
    """Up to three checks by keyword, else a general one for any text (STR17)."""
    # The checks.
    low = F.lower(empty_if_null(text))
    found = _texts_if(
        (low.contains("revenue"), "Verify the revenue claim against recent company filings."),
        (low.contains("margin"), "Check whether the margin claim is supported by reported results."),
        (low.contains("guidance"), "Confirm management guidance in the latest earnings materials."),
        (low.contains("contract") | low.contains("customer"), "Validate customer or contract claims using company disclosures."),
    )
    general = F.array(F.lit("Check the core thesis against filings, transcripts, or reliable reporting."))
    return F.when(F.size(found) > 0, F.slice(found, 1, 3)).when(low != "", general).otherwise(found)


def catalysts(text: Column) -> Column:
    # The labels.
    low = F.lower(empty_if_null(text))
    return _texts_if(
        (low.contains("contract") | low.contains("customer"), "Customer or contract wins"),
        (low.contains("guidance") | low.contains("earnings"), "Upcoming earnings or guidance updates"),
        (low.contains("launch") | low.contains("product"), "Product or launch execution milestones"),
    )


def risks(text: Column) -> Column:
    """Up to four risk labels by keyword (STR18)."""
    low = F.lower(empty_if_null(text))
    # Keyword and label.
    labels = {
        "dilution": "Dilution risk", "execution": "Execution risk", "capex": "Capital intensity", "liquidity": "Liquidity risk",
        "customer concentration": "Customer concentration", "margin": "Margin pressure",
    }
    return F.slice(_texts_if(*((low.contains(k), v) for k, v in labels.items())), 1, 4)


def p_label(p: Column) -> Column:
    return F.when(p.isNull(), "n/a").when(p < 0.001, "<0.001").otherwise(F.format_string("%.3f", p))


def delta_label(x: Column, digits: int = 1) -> Column:
    return F.when(x.isNull(), "n/a").otherwise(F.format_string(f"%+.{digits}f", x.cast("double")))
