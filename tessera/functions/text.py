"""Text functions as native column expressions; only NFC composition, done once on ingest, needs Python.

Matching functions take text that is composed already (``nfc``). A null stays null in cleaning functions and counts
as empty in counting ones.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

LETTER_AR = "[\\u0600-\\u06FF\\u0750-\\u077F\\u08A0-\\u08FF]"
RUN = "[a-z0-9]+|[\\u0621-\\u064A]+"
TOKEN = f"({RUN})"


def nfc(c: Column) -> Column:
    """Canonical composition. Arrow-batched; the only text function that leaves the JVM."""

    @F.pandas_udf("string")
    def compose(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")

    return compose(c)


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use(c)`` with ``c`` evaluated once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(c), use), 1)


def clean_unicode(c: Column) -> Column:
    """Without zero-width and direction marks; no-break spaces become spaces."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), "[\\u200B-\\u200F\\uFEFF]", "")
    return F.translate(c, " ", " ")


#: What ``normalize_arabic`` may change: Arabic, zero-width and direction marks, no-break spaces.
FOLDED = "[\\u00A0\\u0600-\\u06FF\\u200B-\\u200F\\uFEFF]"


def normalize_arabic(c: Column) -> Column:
    """Orthographic folding for matching: tanween alef, marks, tatweel, letter variants and digits, in this order.

    A text without any of them is looked through once and stays as it is.
    """
    return once(c, lambda x: F.when(F.rlike(x, F.lit(FOLDED)), _fold_arabic(x)).otherwise(F.coalesce(x, F.lit(""))))


def _fold_arabic(c: Column) -> Column:
    c = clean_unicode(c)
    c = F.regexp_replace(c, "(\\u064B\\u0627|\\u0627\\u064B)(?![\\u0621-\\u064A])", "")
    c = F.regexp_replace(c, "[\\u0610-\\u061A\\u064B-\\u065F\\u0670\\u06D6-\\u06ED\\u0640]", "")
    return F.translate(c, "أإآٱىةؤئ٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "اااايهءء01234567890123456789")


def normalize_for_matching(c: Column) -> Column:
    c = F.regexp_replace(F.lower(normalize_arabic(c)), r"[^\p{L}\p{N}_\s]", " ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def arabic_ratio(c: Column) -> Column:
    """Arabic letters over Arabic and Latin letters; 0 without any."""
    ar, la = (F.length(F.regexp_replace(c, f"[^{p[1:]}", "")) for p in (LETTER_AR, "[A-Za-z]"))  # what is left without all else
    return F.when(F.rlike(c, F.lit(LETTER_AR)), once(F.array(ar, la), lambda n: F.get(n, F.lit(0)) / (F.get(n, F.lit(0)) + F.get(n, F.lit(1))))).otherwise(F.lit(0.0))


def detect_language(c: Column) -> Column:
    return once(arabic_ratio(c), lambda r: F.when(r >= 0.7, "ar").when(r <= 0.3, "en").otherwise("mixed"))


def query_language(c: Column) -> Column:
    return F.when(arabic_ratio(c) >= 0.5, "ar").otherwise("en")


def clean_text(c: Column) -> Column:
    """Lines with single spaces, trimmed, empty lines dropped; null where nothing is left."""
    lines = F.transform(F.split(clean_unicode(c), r"\r\n|\r|\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"^\s+|\s+$", ""))
    return F.nullif(F.array_join(F.filter(lines, lambda x: x != ""), "\n"), F.lit(""))


def missing(c: Column) -> Column:
    return c.isNull() | (F.regexp_replace(c, r"\s+", "") == "")


def domain_of(url: Column) -> Column:
    host = F.lower(F.try_parse_url(url, F.lit("AUTHORITY")))
    return F.when(F.startswith(host, F.lit("www.")), F.substring(host, 5, 1 << 20)).otherwise(host)


def valid_url(url: Column) -> Column:
    return F.coalesce((F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))) == "https") & F.try_parse_url(url, F.lit("AUTHORITY")).isNotNull(), F.lit(False))


def official_domain(domain: Column) -> Column:
    d = F.lower(F.split_part(domain, F.lit(":"), F.lit(1)))
    return F.coalesce(reduce(lambda a, b: a | b, [F.endswith(d, F.lit(x)) for x in fixed.OFFICIAL_SUFFIXES], d.isin(*fixed.OFFICIAL_DOMAINS)), F.lit(False))


def _strip_en(t: Column) -> Column:
    """Without the first suffix of the list that leaves three letters or more."""
    out = F.when(F.lit(False), t)
    for s in fixed.SUFFIXES_EN:
        out = out.when((F.length(t) > len(s) + 2) & F.endswith(t, F.lit(s)), F.left(t, F.length(t) - len(s)))
    return out.otherwise(t)


def lowered(c: Column) -> Column:
    """A text as its runs are cut from it."""
    return F.lower(normalize_arabic(c))


def runs(c: Column) -> Column:
    """Latin or Arabic runs of a text, of which ``is_term`` keeps some."""
    return F.regexp_extract_all(lowered(c), F.lit(TOKEN), F.lit(1))


def is_term(t: Column) -> Column:
    return ~t.isin(*fixed.STOP_EN, *fixed.STOP_AR)


def stem(t: Column) -> Column:
    """A run lightly stemmed; Latin letters and digits stand before Arabic ones."""
    ar = F.regexp_replace(t, fixed.PREFIX_AR, "")
    ar = F.when(F.length(ar) > 4, F.regexp_replace(ar, fixed.SUFFIX_AR, "")).otherwise(ar)
    return F.when(t < "\u0600", _strip_en(t)).otherwise(ar)


def tokenize(c: Column) -> Column:
    """Search tokens: Latin or Arabic runs, without stop words, lightly stemmed; repeats are kept."""
    return F.transform(F.filter(runs(c), is_term), stem)


def has_terms(c: Column) -> Column:
    """Whether a text has a search token; most texts show one in what is whole of their first words."""
    begin = F.regexp_replace(F.left(c, F.lit(200)), r"\S+$", "")
    return F.coalesce(F.when(F.exists(runs(begin), is_term), True).otherwise(F.exists(runs(c), is_term)), F.lit(False))


def words(c: Column) -> Column:
    """Words for static vectors: the same runs, unfiltered."""
    return F.regexp_extract_all(normalize_for_matching(c), F.lit(TOKEN), F.lit(1))


def light_stem(t: Column) -> Column:
    pre = F.regexp_replace(t, fixed.PREFIX_AR, "")
    both = F.regexp_replace(pre, fixed.SUFFIX_AR_STATIC, "")
    ar = F.when(F.length(both) >= 3, both).otherwise(pre)
    return F.when(F.rlike(t, F.lit("^[a-z0-9]")), _strip_en(t)).otherwise(ar)


def char_ngrams(c: Column, low: int = 3, high: int = 5) -> Column:
    """All n-grams of each word padded by one space on both sides; a word no longer than n gives itself once."""
    padded = F.transform(F.filter(F.split(normalize_for_matching(c), " "), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of(w: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(n)))

    def grams(w: Column) -> Column:
        none = F.array().cast("array<string>")
        return F.concat(*(of(w, n) if n == low else F.when(F.length(w) >= n, of(w, n)).otherwise(none) for n in range(low, high + 1)))

    return F.flatten(F.transform(padded, grams))


def split_items(c: Column) -> Column:
    """Items of an official field: list lines without their dash, or sentences."""
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    listed = F.transform(lines, lambda x: F.when(F.startswith(x, F.lit("- ")), F.trim(F.substring(x, 3, 1 << 20))).otherwise(x))
    sentences = F.flatten(F.transform(lines, lambda x: F.filter(F.transform(F.split(x, r"(?<=[.!?؟])\s+(?=\S)"), lambda s: F.trim(s)), lambda s: s != "")))
    return F.when(F.exists(lines, lambda x: F.startswith(x, F.lit("- "))), listed).otherwise(sentences)


def ascii_digits(c: Column) -> Column:
    return F.translate(c, "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")


def redact(c: Column) -> Column:
    """struct(text, n): identifiers replaced in order; the text as it was where nothing is replaced."""
    t, n = ascii_digits(F.coalesce(c, F.lit(""))), F.lit(0)
    for label, pattern in fixed.REDACTIONS:
        n = n + F.regexp_count(t, F.lit(pattern))
        t = F.regexp_replace(t, pattern, label.replace("[", "\\[").replace("]", "\\]"))
    return F.struct(F.when(n > 0, t).otherwise(c).alias("text"), n.cast("int").alias("n"))


def numbers(c: Column) -> Column:
    """Distinct numbers, thousands separators dropped."""
    found = F.regexp_extract_all(ascii_digits(F.coalesce(c, F.lit(""))), F.lit(f"({fixed.NUMBER})"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit(""))))


def duplicate_keys(url: Column, agency: Column, title: Column) -> tuple[Column, Column]:
    """(url key, title key) by which two records are the same service."""
    u = F.replace(F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), "/+$", ""), F.lit("://www."), F.lit("://"))
    named = F.concat(normalize_for_matching(agency), F.lit("|"), normalize_for_matching(title))
    # A record without agency or title still has a title key of its own form.
    both = F.concat(F.coalesce(agency, F.lit("None")), F.lit("|"), F.coalesce(title, F.lit("None")))
    return F.when(u != "", u).otherwise(named), normalize_for_matching(both)
