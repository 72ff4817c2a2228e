"""Catalog queries. Roles: events are filings (user = company, type = form); orders are awards."""

from __future__ import annotations

from pyspark.sql import functions as F, Window as W

from ..functions import gates, scalars as fn
from ..operators import catalog as ct
from ..staging import stage
from .registry import query, table
from .study import rounded

LEGAL = "(" + "|".join(fn.LEGAL_WORDS) + ")"
AGG_CTE = "agg AS (SELECT user_id::VARCHAR AS company, ts::DATE AS filing_date, event_type AS form, count(*) AS n FROM events GROUP BY ALL)"


def filing_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return ct.ingest(e.select(F.col("user_id").cast("string").alias("cik"), F.lit(None).cast("string").alias("ticker"), F.to_date("ts").alias("filing_date"), F.col("event_type").alias("form")), "2022-01-01")


@query("filing_counts", f"WITH {AGG_CTE} SELECT * FROM agg")
def filing_counts(spark, sf_dir):
    """A12, P5, P6."""
    return ct.counts(filing_rows(spark, sf_dir))


@query("form_calendar", f"""WITH {AGG_CTE} SELECT CASE WHEN grouping(form) = 1 THEN 'all' WHEN grouping(filing_date) = 1 THEN 'form' ELSE 'day_form' END AS level, form, filing_date, sum(n)::BIGINT AS filings
FROM agg GROUP BY ROLLUP (form, filing_date)""")
def form_calendar(spark, sf_dir):
    """A14."""
    return ct.totals(ct.counts(filing_rows(spark, sf_dir)))


@query("catalog_overview", f"""WITH {AGG_CTE} SELECT sum(n)::BIGINT AS total_filings, count(DISTINCT company) AS n_companies, count(DISTINCT filing_date) AS n_filing_days, min(filing_date) AS first_filing_date, max(filing_date) AS last_filing_date FROM agg""")
def catalog_overview(spark, sf_dir):
    """A14."""
    return ct.overview(ct.counts(filing_rows(spark, sf_dir)))


@query("company_rollup", f"""WITH {AGG_CTE}, f AS (SELECT company, sum(n) AS total_filings, to_json(list({{'form': form, 'n': n}} ORDER BY n DESC, form)) AS forms FROM (SELECT company, form, sum(n)::BIGINT AS n FROM agg GROUP BY ALL) GROUP BY 1),
d AS (SELECT company, count(DISTINCT filing_date) AS n_filing_days, min(filing_date) AS first_filing_date, max(filing_date) AS last_filing_date FROM agg GROUP BY 1)
SELECT company, total_filings::BIGINT AS total_filings, forms::VARCHAR AS forms, n_filing_days, first_filing_date, last_filing_date, n_filing_days AS day_entries FROM f JOIN d USING (company)""")
def company_rollup(spark, sf_dir):
    """A15, F21, K5."""
    r = ct.company_rollup(stage(ct.counts(filing_rows(spark, sf_dir)), "agg"))
    return r.select("company", "total_filings", F.to_json("forms").alias("forms"), "n_filing_days", "first_filing_date", "last_filing_date", F.size("filing_days").cast("bigint").alias("day_entries"))


@query("latest_attributes", """SELECT user_id AS company, arg_max(event_type, (ts, event_id)) FILTER (value > 20) AS name, arg_max(props, (ts, event_id)) FILTER (value <= 20) AS ticker FROM events GROUP BY 1""")
def latest_attributes(spark, sf_dir):
    """A13, X2, J26."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("company"), "ts", "event_id", F.when(F.col("value") > 20, F.col("event_type")).alias("name"), F.when(F.col("value") <= 20, F.col("props")).alias("ticker"))
    return ct.latest_attributes(e, "company", F.struct("ts", "event_id"), ["name", "ticker"])


AWARDS_CTE = """co AS (SELECT c_custkey AS cik, 'The ' || c_name || ' Holdings, Inc.' AS company_name, c_nationkey FROM customer),
aw AS (SELECT o_custkey AS cik, CASE WHEN o_orderstatus = 'F' THEN c_name || ' CORP.' ELSE c_name || ' Partners' END AS recipient_name, o_totalprice AS award_amount, CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE o_orderpriority END AS awarding_agency
  FROM orders JOIN customer ON o_custkey = c_custkey),
nm AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(lower(recipient_name), '\\b@LEGAL@\\b\\.?', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g')) AS a,
  trim(regexp_replace(regexp_replace(regexp_replace(lower(company_name), '\\b@LEGAL@\\b\\.?', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g')) AS b FROM aw JOIN co USING (cik)),
fl AS (SELECT *, a = b AS exact_name_match FROM nm)""".replace("@LEGAL@", LEGAL)


def companies(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cik"), F.concat(F.lit("The "), "c_name", F.lit(" Holdings, Inc.")).alias("company_name"), "c_name")


def awards(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cik"), F.col("o_totalprice").alias("award_amount"), "o_orderstatus",
                                              F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.col("o_orderpriority")).alias("awarding_agency"))
    j = o.join(companies(spark, sf_dir), "cik").withColumn("recipient_name", F.when(F.col("o_orderstatus") == "F", F.concat("c_name", F.lit(" CORP."))).otherwise(F.concat("c_name", F.lit(" Partners"))))
    return j.withColumn("exact_name_match", fn.company_name(F.col("recipient_name")) == fn.company_name(F.col("company_name")))


@query("award_summary", f"""WITH {AWARDS_CTE}, ag AS (SELECT cik, coalesce(nullif(awarding_agency, ''), 'Unknown') AS agency, sum(award_amount) AS te FROM fl WHERE exact_name_match GROUP BY ALL),
tp AS (SELECT cik, arg_max(agency, (round(te, 6), agency)) AS top FROM ag GROUP BY 1), g AS (SELECT cik, count(*) AS n, sum(award_amount) AS t, count(*) FILTER (exact_name_match) AS ne, coalesce(sum(award_amount) FILTER (exact_name_match), 0) AS te FROM fl GROUP BY 1)
SELECT cik, company_name, coalesce(n, 0) AS award_count_all_matches, round(coalesce(t, 0), 2) AS total_all_matches, coalesce(ne, 0) AS award_count_exact_name, round(coalesce(te, 0), 2) AS total_exact_name,
  round(100 * coalesce(te, 0) / (SELECT sum(te) FROM g), 4) AS share_of_exact_total_pct, coalesce(top, '') AS top_awarding_agency_exact FROM co LEFT JOIN g USING (cik) LEFT JOIN tp USING (cik)""")
def award_summary(spark, sf_dir):
    """A16, F2, J28, T4."""
    return ct.award_summary(companies(spark, sf_dir).drop("c_name"), awards(spark, sf_dir))


@query("award_manifest", f"""WITH {AWARDS_CTE} SELECT count(*) AS award_rows, count(*) FILTER (exact_name_match) AS exact_rows, round(sum(award_amount) FILTER (exact_name_match), 2) AS exact_total,
  (SELECT count(*) FROM co) AS requested, (SELECT count(*) FROM co WHERE cik NOT IN (SELECT cik FROM aw)) AS failed FROM fl""")
def award_manifest(spark, sf_dir):
    """A42."""
    c, a = companies(spark, sf_dir), stage(awards(spark, sf_dir), "awards")
    return ct.run_manifest(c, c.join(a, "cik", "left_anti"), a)


@query("search_names", r"""WITH n AS (SELECT c_custkey, 'The ' || c_name || ' Holdings, Inc.' AS nm FROM customer)
SELECT c_custkey, coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace(nm, '(?i)\b@LEGAL@\b\.?', ' ', 'g'), '[^\w&'' -]+', ' ', 'g'), '\s+', ' ', 'g')), ''), nm) AS search_name FROM n""".replace("@LEGAL@", LEGAL))
def search_names(spark, sf_dir):
    """F3."""
    c = companies(spark, sf_dir)
    return c.select(F.col("cik").alias("c_custkey"), fn.search_name(F.col("company_name")).alias("search_name"))


@query("industry_share", """WITH p AS (SELECT p_partkey AS cik, CASE WHEN p_partkey > 100 THEN (p_size * 180)::VARCHAR END AS s1, CASE WHEN p_partkey < 50 THEN '7372' END AS s2 FROM part), s AS (SELECT cik, coalesce(s1, s2) AS sic FROM p),
d AS (SELECT cik, (sic::INT // 100) AS k FROM s), g AS (SELECT CASE WHEN k BETWEEN 1 AND 9 THEN 'Agriculture, forestry & fishing' WHEN k BETWEEN 10 AND 14 THEN 'Mining, oil & gas' WHEN k BETWEEN 15 AND 17 THEN 'Construction' WHEN k BETWEEN 20 AND 39 THEN 'Manufacturing'
  WHEN k BETWEEN 40 AND 49 THEN 'Transportation, communications & utilities' WHEN k BETWEEN 50 AND 51 THEN 'Wholesale trade' WHEN k BETWEEN 52 AND 59 THEN 'Retail trade' WHEN k BETWEEN 60 AND 67 THEN 'Finance, insurance & real estate' WHEN k BETWEEN 70 AND 89 THEN 'Services'
  ELSE 'Unknown / unclassified' END AS industry, count(DISTINCT cik) AS filers FROM d GROUP BY 1)
SELECT industry, filers, round(100 * filers / (SELECT sum(filers) FROM g), 2) AS share_pct FROM g""")
def industry_share(spark, sf_dir):
    """A17, J29, J30."""
    p = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "cik")
    listed = p.where("cik > 100").select("cik", (F.col("p_size") * 180).cast("string").alias("sic"))
    unlisted = p.where("cik < 50").select("cik", F.lit("7372").alias("sic"))
    return ct.industry_share(ct.industry_of(p.select("cik"), listed, unlisted), ct.division(F.col("sic")))


@query("industry_filter", """SELECT p_partkey, lpad(p_size::VARCHAR, 4, '0') AS sic, p_name AS display_name FROM part WHERE lpad(p_size::VARCHAR, 4, '0') = '0007'""")
def industry_filter(spark, sf_dir):
    """P7, J27."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cik"), F.concat(F.lit(" "), F.col("p_size").cast("string")).alias("sic"), F.lit("").alias("name"), F.lit("none").alias("sic_description"))
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cik"), F.col("p_name").alias("name"))
    out = ct.display_names(ct.industry_filter(p, "0007"), names)
    return out.select(F.col("cik").alias("p_partkey"), F.lpad(F.trim("sic"), 4, "0").alias("sic"), "display_name")


@query("area_summary", """WITH f AS (SELECT 'src' || (regexp_extract(url, '^https?')) AS area, length(html) AS bytes, CASE WHEN html LIKE '%<table%' THEN 'unreadable' ELSE 'present' END AS status FROM pages),
a(area) AS (VALUES ('srchttp'), ('srchttps'), ('srcftp'))
SELECT a.area, CASE WHEN max(bytes) IS NULL THEN 'missing' WHEN bool_or(f.status = 'unreadable') THEN 'partial' ELSE 'present' END AS status, count(bytes) AS files, coalesce(sum(bytes), 0)::BIGINT AS bytes FROM a LEFT JOIN f USING (area) GROUP BY 1""")
def area_summary(spark, sf_dir):
    """A30."""
    f = table(spark, sf_dir, "pages").select(F.concat(F.lit("src"), F.regexp_extract("url", "^https?", 0)).alias("area"), F.length("html").alias("bytes"), F.lit("file").alias("type"),
                                             F.when(F.col("html").contains("<table"), "unreadable").otherwise("present").alias("status"))
    areas = spark.createDataFrame([("srchttp",), ("srchttps",), ("srcftp",)], "area STRING")
    return ct.area_summary(areas, f)


@query("extension_counts", r"""WITH p AS (SELECT regexp_extract(url, '^(https?)://', 1) AS area, regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '(\.[a-z]+)$', 1) AS ext FROM pages) SELECT area, ext, count(*) AS files FROM p GROUP BY ALL""")
def extension_counts(spark, sf_dir):
    """A41."""
    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^(https?)://", 1).alias("area"), F.regexp_extract(F.substring_index(F.substring_index("url", "?", 1), "#", 1), r"(\.[a-z]+)$", 1).alias("ext"))
    return p.groupBy("area", "ext").agg(F.count("*").alias("files"))


@query("first_per_area", """SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 3""")
def first_per_area(spark, sf_dir):
    """The rank filter is applied before the shuffle as a per-partition top-k."""
    d = table(spark, sf_dir, "documents").select("lang", "doc_id")
    return d.withColumn("rn", F.row_number().over(W.partitionBy("lang").orderBy("doc_id"))).where("rn <= 3").drop("rn")


@query("observed_range", """SELECT k AS instrument, min(d) AS first_at, max(d) AS last_at, count(*) AS observations FROM (SELECT l_suppkey AS k, l_shipdate::DATE AS d FROM lineitem UNION ALL SELECT o_custkey, o_orderdate::DATE FROM orders) GROUP BY 1""")
def observed_range(spark, sf_dir):
    """A37, T7."""
    a = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("instrument"), F.to_date("l_shipdate").alias("at"))
    b = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("instrument"), F.to_date("o_orderdate").alias("at"))
    return ct.observed_range([a, b], "instrument", "at")


@query("taxonomy_counts", """SELECT count(DISTINCT p_type) AS primary_category, count(DISTINCT p_brand) AS secondary_category, count(DISTINCT p_name) AS tertiary_category FROM part""")
def taxonomy_counts(spark, sf_dir):
    """S17."""
    from ..sources.readers import taxonomy_counts as tc
    return tc(table(spark, sf_dir, "part").select(F.col("p_type").alias("primary_category"), F.col("p_brand").alias("secondary_category"), F.col("p_name").alias("tertiary_category")))


@query("url_gate", r"""WITH u AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, list_filter([CASE WHEN scheme <> 'https' THEN 'scheme' END, CASE WHEN host NOT LIKE '%.com' THEN 'host' END, CASE WHEN contains(url, '?') THEN 'query' END, CASE WHEN contains(url, '#') THEN 'fragment' END,
  CASE WHEN contains(path, '/../') THEN 'dot_segment' END], lambda x: x IS NOT NULL) AS reasons FROM u""")
def url_gate(spark, sf_dir):
    """P9."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", gates.url_reasons(F.col("url"), F.parse_url("url", F.lit("HOST")).endswith(".com")).alias("reasons"))
