"""Text expressions: trigram similarity, names, identifiers, SQL fingerprints, language. All built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal forms that end company names.
LEGAL_FORMS = ("inc", "corp", "corporation", "ltd", "limited", "holding", "holdings", "llc", "plc", "co", "company", "sa", "ag", "gmbh", "kgaa", "nv", "bv")
# Frequent English words, for telling English text.
ENGLISH = ("the", "be", "to", "of", "and", "a", "in", "that", "have", "i", "it", "for", "not", "on", "with", "he", "as", "you", "do", "at")


def trigrams(text: Column) -> Column:
    """Set of 3-grams of the lower-cased words, each padded with two spaces before and one behind."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w) - 2), lambda i: w.substr(i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared 3-grams over all 3-grams; 0 if there are none."""
    x, y = trigrams(a), trigrams(b)
    every = F.size(F.array_union(x, y))
    return F.when(every > 0, F.size(F.array_intersect(x, y)) / every).otherwise(F.lit(0.0))


def company_key(name: Column) -> Column:
    """Lower case, no punctuation, legal forms stripped from the end as often as they occur."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"[.,'’()]", ""), r"[^\p{L}\p{N}&]+", " "))
    cut = F.regexp_replace(plain, rf"(?: (?:{'|'.join(LEGAL_FORMS)}))+$", "")
    return F.trim(F.regexp_replace(cut, r"(?:\s*&)+$", ""))


def filer_id(value: Column) -> Column:
    """Ten digits, zeros in front."""
    return F.lpad(F.regexp_replace(value, r"[^0-9]", ""), 10, "0")


def bare_filer_id(value: Column) -> Column:
    return F.ltrim(F.regexp_replace(value, r"[^0-9]", ""), F.lit("0"))


def domain_name(url: Column) -> Column:
    """Host without scheme, user, port and leading www."""
    return F.regexp_replace(F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@]*@)?([^/:?#]+)", 1), r"^www\.", "")


def sql_fingerprint(statement: Column) -> Column:
    """sha256 of the statement without comments, literals, numbers and surplus white space."""
    bare = F.regexp_replace(F.regexp_replace(statement, r"(?s)/\*.*?\*/", " "), r"--[^\n]*", " ")
    bare = F.regexp_replace(bare, r"'(?:[^']|'')*'", "?")
    bare = F.regexp_replace(bare, r"\b\d+(?:\.\d+)?\b", "?")
    return F.sha2(F.lower(F.trim(F.regexp_replace(bare, r"\s+", " "))).cast("binary"), 256)


def looks_english(text: Column) -> Column:
    """More than a tenth of the first 200 words (of a-z alone) are frequent English words."""
    words = F.slice(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w.rlike("^[a-z]+$")), 1, 200)
    return F.coalesce(F.size(F.filter(words, lambda w: w.isin(*ENGLISH))) > 0.1 * F.size(words), F.lit(False)) & (F.size(words) > 0)


def canonical_date(raw: Column) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD to a date; missing parts are 01, anything else is null."""
    full = F.when(raw.rlike(r"^\d{4}$"), F.concat(raw, F.lit("-01-01"))).when(raw.rlike(r"^\d{4}-\d{2}$"), F.concat(raw, F.lit("-01"))).when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), raw)
    return F.try_to_timestamp(full, F.lit("yyyy-MM-dd")).cast("date")
