"""Scalar column functions (F1-F4, F6-F24): JVM expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal-form words removed before company names are compared.
LEGAL_WORDS = ("inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "llc", "plc", "holding",
               "holdings", "group", "the")
LEGAL_PATTERN = r"\b(" + "|".join(LEGAL_WORDS) + r")\b\.?"
# Every character the reference treats as white space, as one regex class.
WHITESPACE = r"\t-\r\x1c- \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WHITESPACE_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
ITEM_PATTERN = r"(?i)\bItem[" + WHITESPACE + r"]+(\d{1,2}\.\d{2})\b"
WORD_PATTERN = r"[A-Za-z]+(?:'[A-Za-z]+)?"
AWARE_STAMP = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})$"


def ticker(c: Column) -> Column:
    return F.nullif(F.upper(F.regexp_replace(F.trim(c), "/", ".")), F.lit(""))


def zero_pad(c: Column, width: int = 10) -> Column:
    return F.lpad(F.trim(c.cast("string")), width, "0")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def company_name(c: Column) -> Column:
    """lower case, legal words and punctuation dropped, single blanks."""
    return squeeze(F.regexp_replace(F.regexp_replace(F.lower(c), LEGAL_PATTERN, " "), "[^a-z0-9 ]+", " "))


def search_name(c: Column) -> Column:
    """display-case search phrase; the original name when nothing is left."""
    cleaned = squeeze(F.regexp_replace(F.regexp_replace(c, "(?i)" + LEGAL_PATTERN, " "), r"(?U)[^\w&' -]+", " "))
    return F.coalesce(F.nullif(cleaned, F.lit("")), c)


def normalize_text(c: Column) -> Column:
    """line ends become \\n, no-break spaces become blanks."""
    return F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), " ", " ")


def item_heading(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, ITEM_PATTERN, 1), F.lit(""))


def words(c: Column) -> Column:
    """upper-case word tokens, apostrophes kept inside a word."""
    return F.regexp_extract_all(F.upper(c), F.lit(WORD_PATTERN), F.lit(0))


def strip_tags(c: Column) -> Column:
    """F8: tags to blanks and the five common named entities."""
    out = F.regexp_replace(c, "<[^>]+>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - levenshtein / longer length; 1 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def span_id(document: Column, digest: Column, start: Column, end: Column) -> Column:
    """identity hash of an exact span."""
    return F.sha2(F.concat_ws(":", document, digest, start.cast("string"), end.cast("string")), 256)


def canonical_digest(fields: dict[str, Column]) -> Column:
    """SHA-256 of compact JSON with sorted keys; NULL members are written as null."""
    def encode(name, col):
        value = F.to_json(F.struct(col.alias("v")), {"ignoreNullFields": "false"})
        return F.concat(F.lit(f'"{name}":'), F.regexp_extract(value, r'(?s)^\{"v":(.*)\}$', 1))
    body = F.concat_ws(",", *[encode(n, fields[n]) for n in sorted(fields)])
    return F.sha2(F.concat(F.lit("{"), body, F.lit("}")), 256)


def aware_utc(c: Column) -> Column:
    """timestamp only from text with a time and an explicit offset; anything else is NULL."""
    return F.when(c.rlike(AWARE_STAMP), F.try_to_timestamp(c))


def utc_stamp(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def day_block(c: Column, width: int) -> Column:
    """calendar block index counted from the epoch."""
    return F.floor(F.unix_date(F.to_date(c)) / width)


def finite(c: Column) -> Column:
    """F16: true for numbers that are neither NULL, NaN nor infinite."""
    d = c.try_cast("double")
    return F.coalesce(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), F.lit(False))


def event_id(cik: Column, accession: Column, tick: Column) -> Column:
    return F.concat_ws(":", F.lit("CIK"), zero_pad(cik), accession, tick)


def sorted_reasons(c: Column) -> Column:
    return F.array_sort(F.array_distinct(c))


def map_by_value_desc(c: Column) -> Column:
    """map entries ordered by value descending, key ascending, as an array of structs."""
    return F.array_sort(F.map_entries(c), lambda a, b: F.when(a["value"] > b["value"], -1)
                        .when(a["value"] < b["value"], 1).when(a["key"] < b["key"], -1)
                        .when(a["key"] > b["key"], 1).otherwise(0))


def relative_path_ok(c: Column, prefix: str) -> Column:
    """stays below `prefix`: no absolute path, no backslash, no parent steps after the prefix."""
    rest = F.right(c, F.greatest(F.length(c) - len(prefix), F.lit(0)))
    return F.coalesce(c.startswith(prefix) & ~c.contains("\\")
                      & ~F.array_contains(F.split(rest, "/"), "..") & (F.length(rest) > 0), F.lit(False))


def filer_key(cik: Column, tick: Column) -> Column:
    """P5: cik, else the ticker marked as such, else UNKNOWN."""
    return F.coalesce(F.nullif(cik, F.lit("")), F.concat(F.lit("TICKER:"), F.nullif(tick, F.lit(""))), F.lit("UNKNOWN"))


def public_evidence(c: Column) -> Column:
    """Evidence text that is more than a placeholder word."""
    return F.coalesce(~F.lower(F.trim(c)).isin(*PLACEHOLDERS), F.lit(False))


# Words that do not count as evidence of a public time.
PLACEHOLDERS = ("", "unverified", "unknown", "none", "null", "n/a", "true", "false", "verified")
