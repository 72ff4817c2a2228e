"""Submission inventory, saved OCR pages, exhibits and duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..staging import stage
from .skew import hot_lookup

# Key words that mark an earnings release.
EARNINGS = r"(?i)\b(earnings|financial results|quarterly results|results of operations)\b"
MONEY = r"(?i)\b(revenue|income|sales|earnings per share|profit|loss)\b"

# Items and exhibits that a filing names.
ITEM = r"(?i)\bItem\s+(\d\.\d{2})\b"
EXHIBIT = r"(?i)\bExhibit\s+(99(?:\.\d+)?)\b"


def role(kind: Column, plain: Column) -> Column:
    """Primary filing, earnings release, other exhibit or unclassified."""
    release = plain.rlike(EARNINGS) & plain.rlike(MONEY)
    return (F.when(kind.isin("8-K", "8-K/A"), "primary_filing").when(kind.startswith("EX-99"), F.when(release, "earnings_release").otherwise("unclassified"))
            .when(kind.startswith("EX-"), "other_exhibit").otherwise("unclassified"))


def inventory(subs: DataFrame, cik: str, accession: str, payload: str) -> DataFrame:
    """One row per document block of a submission text.

    Blocks are cut and described inside the row. Encoded PDF bodies are flagged unsupported.
    """
    # what stands before a closing mark, from its opening mark on; then the header as one (mark, value) per line, and the body
    ends = F.split(F.col(payload), "(?i)</DOCUMENT>")
    opened = F.filter(F.slice(ends, F.lit(1), F.greatest(F.size(ends) - 1, F.lit(0))), lambda x: x.rlike("(?i)<DOCUMENT>"))
    b = subs.select(fn.zero_pad(F.col(cik)).alias("cik"), F.col(accession).alias("accession"), F.posexplode(F.transform(opened, lambda x: F.get(F.split(x, "(?i)<DOCUMENT>", 2), F.lit(1)))).alias("sequence", "block"))
    parts = F.split("block", "(?i)<TEXT>", 2)
    lines = F.transform(F.split(F.get(parts, F.lit(0)), "[\r\n]+"), lambda x: F.split(F.trim(x), ">", 2))
    value = lambda name: F.coalesce(F.trim(F.get(F.split(F.get(F.get(F.filter("header", lambda x: F.upper(F.get(x, F.lit(0))) == f"<{name}"), F.lit(0)), F.lit(1)), "<"), F.lit(0))), F.lit(""))
    body = F.split(F.get(parts, F.lit(1)), "(?i)</TEXT>", 2)
    b = b.withColumn("header", lines).select("cik", "accession", "sequence", F.upper(value("TYPE")).alias("kind"), F.nullif(value("FILENAME"), F.lit("")).alias("filename"), F.when(F.size(body) > 1, F.get(body, F.lit(0))).alias("content"))
    pdf = F.coalesce(F.lower("filename").endswith(".pdf"), F.lit(False)) & F.col("content").isNotNull()
    raw_pdf = F.regexp_replace("content", r"(?i)^\s*<PDF>\s*", "").startswith("%PDF-")
    plain = fn.strip_tags(F.coalesce("content", F.lit("")))
    status = (F.when(pdf & ~raw_pdf, "encoded_binary_unsupported").when(F.col("content").isNull(), "incomplete_text")
              .when(F.col("filename").isNull(), "missing_filename").otherwise("complete"))
    items = F.when(F.col("kind").isin("8-K", "8-K/A"), F.array_sort(F.array_distinct(F.regexp_extract_all(plain, F.lit(ITEM), F.lit(1)))))
    refs = F.when(F.col("kind").isin("8-K", "8-K/A"), F.array_distinct(F.regexp_extract_all(plain, F.lit(EXHIBIT), F.lit(1))))
    return b.select("cik", "accession", "sequence", F.concat_ws(":", "cik", "accession", F.coalesce("filename", F.concat(status, F.lit(":"), F.col("kind")))).alias("document_id"),
                    F.nullif("kind", F.lit("")).alias("kind"), "filename", role(F.col("kind"), plain).alias("document_role"), status.alias("inventory_status"),
                    F.coalesce(items, F.array().cast("array<string>")).alias("sec_items"), F.coalesce(refs, F.array().cast("array<string>")).alias("exhibit_refs"),
                    F.sha2("content", 256).alias("source_sha256"), "content")


def missing_exhibits(docs: DataFrame) -> DataFrame:
    """Exhibits a primary filing refers to that its submission does not hold."""
    refs = docs.where("document_role = 'primary_filing'").select("cik", "accession", F.explode("exhibit_refs").alias("exhibit")).distinct()
    have = docs.where("kind LIKE 'EX-%'").select("cik", "accession", F.expr("substr(kind, 4)").alias("exhibit")).distinct()
    return refs.join(have, ["cik", "accession", "exhibit"], "left_anti")


def missing_primary(docs: DataFrame, subs: DataFrame, cik: str, accession: str) -> DataFrame:
    """Submissions without a primary filing, including those with no document block at all."""
    have = docs.where("document_role = 'primary_filing'").select("cik", "accession").distinct()
    return subs.select(fn.zero_pad(F.col(cik)).alias("cik"), F.col(accession).alias("accession")).distinct().join(have, ["cik", "accession"], "left_anti")


def analysis_documents(docs: DataFrame) -> DataFrame:
    """P3."""
    return docs.where((F.col("document_role") == "primary_filing") | F.coalesce(F.col("kind"), F.lit("")).startswith("EX-99"))


def family(items: Column, members: Sequence[str]) -> Column:
    """in_family, mixed or outside."""
    inside = F.size(F.array_intersect(items, F.array(*map(F.lit, members))))
    rest = F.size(F.array_except(items, F.array(*map(F.lit, members))))
    return F.when(inside == 0, "outside").when(rest == 0, "in_family").otherwise("mixed")


def visible_before(docs: DataFrame, cutoff: Column, target: Column) -> DataFrame:
    """Documents public before the cutoff, received and processed by it, and not the target filing."""
    return docs.where((F.col("public_at") < cutoff) & (F.col("received_at") <= cutoff) & (F.col("processed_at") <= cutoff) & ~F.col("accession").eqNullSafe(target))


def duplicates(docs: DataFrame, doc: str, text: str, scope: Sequence[str] = ()) -> DataFrame:
    """Later copies point at the first document with the same content; unique rows stay NULL."""
    h = docs.select(*scope, F.col(doc).alias("document_id"), F.sha2(F.col(text), 256).alias("sha256"))
    keys = [*scope, "sha256"]
    groups = stage(h.groupBy(*keys).agg(F.min("document_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1"), "copies")
    j = hot_lookup(h, groups, keys, "copies")
    return j.select(*scope, "document_id", "sha256", F.when(F.col("document_id") > F.col("first_id"), F.col("first_id")).alias("duplicate_of"))


def normalize_ocr(payloads: DataFrame, doc: str, pages: str, text: str) -> DataFrame:
    """One text per saved payload with page offsets, order check and flags; folded inside the row."""
    p = payloads.withColumn("_t", F.transform(pages, lambda x: fn.normalize_text(F.coalesce(x["text"], F.lit("")))))
    joined = F.array_join("_t", "\n\f\n")
    starts = F.transform("_t", lambda _, i: F.aggregate(F.slice("_t", 1, i), F.lit(0), lambda a, t: a + F.length(t) + 3))
    numbers = F.transform(pages, lambda x, i: F.coalesce(x["number"], i + 1))
    recs = F.transform(F.arrays_zip(numbers.alias("n"), starts.alias("s"), F.col("_t").alias("t")), lambda z: F.struct(
        z["n"].alias("page_number"), z["s"].alias("char_start"), (z["s"] + F.length(z["t"])).alias("char_end")))
    given = fn.normalize_text(F.col(text))
    flags = F.array_compact(F.array(
        F.lit("unverified_reading_order"), F.lit("possible_negation_sign_unit_errors"),
        F.when(F.exists(pages, lambda x: x["text"].isNull()), "malformed_text"),
        F.when((F.size(pages) > 0) & given.isNotNull() & (given != joined), "document_page_text_mismatch"),
        F.when((F.size(pages) > 0) & (numbers != F.sequence(F.lit(1), F.size(pages))), "malformed_page_order"),
        F.when(F.col("source_sha256").isNull(), "source_hash_unavailable"),
        F.when(F.exists(pages, lambda x: F.array_contains(F.coalesce(x["quality_flags"], F.array().cast("array<string>")), "generation_token_limit_reached")), "incomplete_text")))
    flags = F.concat(flags, F.flatten(F.transform(pages, lambda x: F.coalesce(x["quality_flags"], F.array().cast("array<string>")))))
    final = F.when(F.size(pages) > 0, joined).otherwise(F.coalesce(given, F.lit("")))
    flags = F.concat(flags, F.when(F.length(F.trim(final)) == 0, F.array(F.lit("incomplete_text"))).otherwise(F.array().cast("array<string>")))
    return p.select(F.col(doc).alias("document_id"), final.alias("normalized_text"), F.sha2(final, 256).alias("text_sha256"), recs.alias("page_records"),
                    fn.sorted_reasons(flags).alias("quality_flags"))


def page_confidence(confidences: Column) -> Column:
    """Mean of word confidences inside [0, 100]; NULL when none."""
    ok = F.filter(confidences, lambda x: x.between(0, 100))
    return F.when(F.size(ok) > 0, F.aggregate(ok, F.lit(0.0), lambda a, x: a + x) / F.size(ok))


def comparison_metadata(docs: DataFrame, keys: Sequence[str], doc: str, public: str, verified: Column) -> DataFrame:
    """Earliest and latest document of a filing, only if every document has a verified public time."""
    ok = F.bool_and(F.coalesce(verified & F.col(public).isNotNull(), F.lit(False)))
    order = F.struct(F.col(public), F.col(doc))
    g = docs.groupBy(*keys).agg(ok.alias("_ok"), F.min_by(doc, order).alias("_a"), F.max_by(doc, order).alias("_z"))
    return g.select(*keys, F.when(F.col("_ok"), F.col("_a")).alias("earliest"), F.when(F.col("_ok"), F.col("_z")).alias("latest"))


# Readiness codes, and inventory statuses that count as covered.
CLOCKS = (("public_at", "public_timestamp_unverified", "public_after_decision"), ("received_at", "receipt_timestamp_unavailable", "receipt_after_decision"), ("processed_at", "processing_timestamp_unavailable", "processing_after_decision"))
COVERED = ("complete", "available", "retrieved", "ok")


def readiness(inventory: DataFrame, transcripts: DataFrame, group: str, decision: Column, anticipation: bool = False, target: Column | None = None) -> DataFrame:
    """(group, reason_codes): what keeps the documents of a group from being used at the decision time.

    inventory: group, document_id, accession, identity_status, inventory_status, public_at, public_evidence, received_at;
    transcripts: document_id, processed_at, normalized_text. Codes are few, so their sets stay small at any number of documents.
    """
    target = F.lit(None).cast("string") if target is None else target
    d = inventory.join(transcripts, "document_id", "left")
    codes = [F.when(decision.isNull(), "decision_timestamp_missing"), F.when(~F.col("identity_status").eqNullSafe("verified"), "submission_identity_unverified"),
             F.when(~F.coalesce(F.col("inventory_status").isin(*COVERED), F.lit(False)), "document_coverage_incomplete"), F.when(F.trim(F.coalesce("normalized_text", F.lit(""))) == "", "document_text_missing")]
    if anticipation:
        codes += [F.when(target.isNull(), "target_accession_missing"), F.when(F.col("accession") == target, "target_filing_leakage")]
    for clock, missing, late in CLOCKS:
        at = F.col(clock)
        unknown = at.isNull() | ~fn.public_evidence(F.col("public_evidence")) if clock == "public_at" else at.isNull()
        after = (at >= decision) if anticipation and clock == "public_at" else (at > decision)
        codes.append(F.when(unknown, missing).when(after, late))
    found = d.select(F.col(group), F.explode_outer(F.array_compact(F.array(*codes))).alias("code"))
    return found.groupBy(group).agg(F.array_sort(F.collect_set("code")).alias("reason_codes"))
