"""Filing catalogs, awards, industries and inventories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as fn

# Industry divisions by the first two digits of the industry code.
DIVISIONS = ((1, 9, "Agriculture, forestry & fishing"), (10, 14, "Mining, oil & gas"), (15, 17, "Construction"), (20, 39, "Manufacturing"),
             (40, 49, "Transportation, communications & utilities"), (50, 51, "Wholesale trade"), (52, 59, "Retail trade"),
             (60, 67, "Finance, insurance & real estate"), (70, 89, "Services"))
UNKNOWN = "Unknown / unclassified"


def ingest(rows: DataFrame, start: str, end: str | None = None, forms: Sequence[str] | None = None) -> DataFrame:
    """Window and form filters (pushed to the scan), company key, form default."""
    r = rows.where(F.col("filing_date").isNotNull() & (F.col("filing_date") >= F.lit(start).cast("date")))
    r = r.where(F.col("filing_date") <= F.lit(end).cast("date")) if end else r
    r = r.where(F.col("form").isin(*forms)) if forms else r
    return r.withColumn("company", fn.filer_key(F.col("cik"), F.col("ticker"))).withColumn("form", F.coalesce("form", F.lit("(unknown)")))


def counts(rows: DataFrame) -> DataFrame:
    """A12."""
    return rows.groupBy("company", "filing_date", "form").agg(F.count("*").alias("n"))


def latest_attributes(rows: DataFrame, key: str, order: Column, cols: Sequence[str]) -> DataFrame:
    """Latest non-null value of each attribute."""
    return rows.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in cols])


def totals(agg: DataFrame) -> DataFrame:
    """Form totals, day totals by form and the grand total in one grouping-sets pass.

    `level` is "form", "day_form" or "all".
    """
    g = agg.rollup("form", "filing_date").agg(F.sum("n").alias("filings"), F.grouping_id().alias("_g"))
    level = F.when(F.col("_g") == 0, "day_form").when(F.col("_g") == 1, "form").otherwise("all")
    return g.select(level.alias("level"), "form", "filing_date", "filings")


def overview(agg: DataFrame) -> DataFrame:
    """Distinct companies and days with the covered range."""
    return agg.agg(F.sum("n").alias("total_filings"), F.countDistinct("company").alias("n_companies"), F.countDistinct("filing_date").alias("n_filing_days"),
                   F.min("filing_date").alias("first_filing_date"), F.max("filing_date").alias("last_filing_date"))


def company_rollup(agg: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Nested roll-up per company; the arrays hold one entry per form and per filing day.

    Rows are first reduced to (company, day, form), so a company's arrays are bounded by days × forms.
    """
    per_form = agg.groupBy("company", "form").agg(F.sum("n").alias("n"))
    forms = per_form.groupBy("company").agg(F.sum("n").alias("total_filings"), F.array_sort(
        F.collect_list(F.struct((-F.col("n")).alias("k"), F.col("form"), F.col("n")))).alias("_f"))
    forms = forms.select("company", "total_filings", F.transform("_f", lambda x: F.struct(x["form"].alias("form"), x["n"].alias("n"))).alias("forms"))
    per_day = agg.groupBy("company", "filing_date").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("form", "n")))).alias("d"))
    span = per_day.groupBy("company").agg(F.count("*").alias("n_filing_days"), F.min("filing_date").alias("first_filing_date"), F.max("filing_date").alias("last_filing_date"),
                                          F.map_from_entries(F.collect_list(F.struct(F.col("filing_date").cast("string"), "d"))).alias("filing_days"))
    out = forms.join(span, "company")
    return out.join(names, out["company"] == names["key"], "left").drop("key") if names is not None else out


def awards_flagged(awards: DataFrame, companies: DataFrame, on: str) -> DataFrame:
    """Award rows of a company with an exact normalized-name flag."""
    j = awards.join(companies, on)
    return j.withColumn("exact_name_match", fn.company_name(F.col("recipient_name")) == fn.company_name(F.col("company_name")))


def award_summary(companies: DataFrame, awards: DataFrame) -> DataFrame:
    """Every company with all-match and exact-match totals, its share and top agency."""
    exact = F.col("exact_name_match")
    amt = F.coalesce("award_amount", F.lit(0.0))
    per_agency = awards.groupBy("cik", F.coalesce(F.nullif("awarding_agency", F.lit("")), F.lit("Unknown")).alias("agency")).agg(
        F.count("*").alias("n"), F.sum(amt).alias("t"), F.count_if(exact).alias("ne"), F.sum(F.when(exact, amt)).alias("te"))
    g = per_agency.groupBy("cik").agg(F.sum("n").alias("n"), F.sum("t").alias("t"), F.sum("ne").alias("ne"), F.coalesce(F.sum("te"), F.lit(0.0)).alias("te"),
                                      F.max_by("agency", F.when(F.col("ne") > 0, F.struct(F.round("te", 6), F.col("agency")))).alias("top"))
    grand = g.agg(F.when(F.sum("te") != 0, F.sum("te")).otherwise(F.lit(1.0)).alias("grand")).scalar()
    j = companies.join(g, "cik", "left")
    z = lambda c, d: F.coalesce(F.col(c), F.lit(d))
    return j.select("cik", "company_name", z("n", 0).alias("award_count_all_matches"), F.round(z("t", 0.0), 2).alias("total_all_matches"), z("ne", 0).alias("award_count_exact_name"),
                    F.round(z("te", 0.0), 2).alias("total_exact_name"), F.round(100 * z("te", 0.0) / grand, 4).alias("share_of_exact_total_pct"),
                    z("top", "").alias("top_awarding_agency_exact"))


def division(code: Column) -> Column:
    """Industry division from a four-digit code."""
    two = F.floor(code.try_cast("int") / 100)
    out = F.lit(UNKNOWN)
    for lo, hi, name in DIVISIONS:
        out = F.when(two.between(lo, hi), name).otherwise(out)
    return out


def industry_of(filers: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Industry code by exact filer id from two sources; unmatched filers stay."""
    a = first.select("cik", F.col("sic").alias("_s1"))
    b = second.select("cik", F.col("sic").alias("_s2"))
    return filers.join(a, "cik", "left").join(b, "cik", "left").withColumn("sic", F.coalesce("_s1", "_s2")).drop("_s1", "_s2")


def industry_share(filers: DataFrame, group: Column) -> DataFrame:
    """Distinct filers and share of all filers, unclassified ones included."""
    g = filers.groupBy(group.alias("industry")).agg(F.countDistinct("cik").alias("filers"))
    total = g.agg(F.sum("filers")).scalar()
    return g.select("industry", "filers", F.round(100 * F.col("filers") / total, 2).alias("share_pct"))


def industry_filter(filers: DataFrame, sic: str) -> DataFrame:
    """P7."""
    return filers.where(F.lpad(F.trim("sic"), 4, "0") == sic)


def display_names(filers: DataFrame, names: DataFrame) -> DataFrame:
    """Preferred display name with fallbacks."""
    n = names.select("cik", F.nullif(F.col("name"), F.lit("")).alias("_n"))
    return filers.join(n, "cik", "left").withColumn("display_name", F.trim(F.coalesce("_n", F.nullif("name", F.lit("")), "sic_description"))).drop("_n")


def area_summary(areas: DataFrame, files: DataFrame) -> DataFrame:
    """Every area with file and byte totals; areas without files are missing."""
    g = files.groupBy("area").agg(F.count_if(F.col("type") != "directory").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.bool_or(F.col("status") == "unreadable").alias("_u"))
    j = areas.join(g, "area", "left")
    status = F.when(F.col("files").isNull(), "missing").when(F.col("_u"), "partial").otherwise("present")
    return j.select("area", status.alias("status"), F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def observed_range(parts: Sequence[DataFrame], instrument: str, at: str) -> DataFrame:
    """First and last observation per instrument over several workflows."""
    u = parts[0].select(instrument, at)
    for p in parts[1:]:
        u = u.unionByName(p.select(instrument, at))
    return u.groupBy(instrument).agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("observations"))


def run_manifest(requested: DataFrame, failed: DataFrame, awards: DataFrame) -> DataFrame:
    """One row of run counts."""
    a = awards.agg(F.count("*").alias("award_rows"), F.count_if("exact_name_match").alias("exact_rows"), F.round(F.coalesce(F.sum(F.when(F.col("exact_name_match"), F.col("award_amount"))), F.lit(0.0)), 2).alias("exact_total"))
    return a.select("*", requested.agg(F.count("*")).scalar().alias("requested"), failed.agg(F.count("*")).scalar().alias("failed"))
