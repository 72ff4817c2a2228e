"""Landed files: the provided tables are written the way they would arrive, into the shared stage folder, and read back (S1-S3, S5-S8, S13-S16,
S18-S24, K4, K5). A file holds a page of many rows or an array of many documents, so the number of files is a small share of the rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import events as ev
from ..sources import readers as rd, sinks
from ..staging import folder
from .registry import query, table

#: Rows of a landed page.
PAGE = 500
#: Pages, and small documents, that one landed file holds as an array: a few MB.
PAGES, DOCUMENTS = 50, 5000


def _place(spark, name: str) -> str:
    return f"{folder(spark)}/tidemark/landed-{name}-{uuid.uuid4().hex}"


def _lines(df: DataFrame, name: str) -> str:
    """Text lines (column value) as files of many lines."""
    to = _place(df.sparkSession, name)
    df.select("value").write.text(to)
    return to


def _documents(df: DataFrame, name: str, key: str) -> str:
    """One file per row: column value below a folder named by the key."""
    to = _place(df.sparkSession, name)
    df.select(key, "value").repartition(key).write.partitionBy(key).text(to)
    return to


def _arrays(df: DataFrame, name: str, key: str, each: int) -> str:
    """JSON documents (column value), those of `each` neighbouring keys as the array of one file."""
    joined = F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit("]"))
    return _documents(df.groupBy(F.floor(F.col(key) / each).alias("file")).agg(joined.alias("value")), name, "file")


def _pages(df: DataFrame, name: str, number, row) -> str:
    """API pages: {"status", "results": [rows of one page], "next_url"}, PAGES of them a file."""
    body = F.to_json(F.struct(F.lit("OK").alias("status"), F.collect_list(row).alias("results"), F.lit("https://example.org/next").alias("next_url")))
    return _arrays(df.groupBy(F.floor(number / PAGE).alias("page")).agg(body.alias("value")), name, "page", PAGES)


@query("api_pages", """SELECT lpad(o_orderkey::VARCHAR, 12, '0') AS accession_number, o_custkey::VARCHAR AS cik, o_orderdate::DATE AS filing_date, o_orderpriority AS tertiary_category, ['c' || (o_custkey % 7), 'x'] AS tickers FROM orders""")
def api_pages(spark, sf_dir):
    """Rows of landed pages."""
    row = F.struct(F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("accession_number"), F.col("o_custkey").cast("string").alias("cik"), F.to_date("o_orderdate").alias("filing_date"),
                   F.col("o_orderpriority").alias("tertiary_category"), F.array(F.concat(F.lit("c"), (F.col("o_custkey") % 7).cast("string")), F.lit("x")).alias("tickers"), F.lit(1.5).alias("not_read"))
    at = _pages(table(spark, sf_dir, "orders"), "orders", F.col("o_orderkey"), row)
    return rd.pages(spark, at, rd.DISCLOSURE).select("accession_number", "cik", "filing_date", "tertiary_category", "tickers")


@query("disclosure_scan", """SELECT o_orderkey::VARCHAR AS accession_number, o_orderdate::DATE AS filing_date, 'T' || (o_custkey % 7) AS ticker FROM orders
WHERE o_orderpriority = '2-HIGH' AND o_orderdate::DATE BETWEEN DATE '1995-03-01' AND DATE '1996-02-29'""")
def disclosure_scan(spark, sf_dir):
    """Tag and date range over landed pages, tickers normalized."""
    row = F.struct(F.col("o_orderkey").cast("string").alias("accession_number"), F.to_date("o_orderdate").alias("filing_date"), F.col("o_orderpriority").alias("tertiary_category"),
                   F.array(F.concat(F.lit(" t"), (F.col("o_custkey") % 7).cast("string"), F.lit(" "))).alias("tickers"))
    at = _pages(table(spark, sf_dir, "orders"), "disclosures", F.col("o_orderkey"), row)
    hits = ev.disclosures(rd.pages(spark, at, rd.DISCLOSURE), "2-HIGH", "1995-03-01", "1996-02-29")
    return ev.explode_tickers(hits).select("accession_number", "filing_date", "ticker")


@query("contract_snapshot", """SELECT l_orderkey::VARCHAR || '-' || l_linenumber AS contract, l_shipdate::DATE AS as_of, (l_shipdate::DATE + (l_partkey % 200)::INT) AS expiration_date, (l_partkey % 200)::INT AS dte
FROM lineitem WHERE l_quantity % 3 <> 0 AND l_partkey % 200 BETWEEN 21 AND 45""")
def contract_snapshot(spark, sf_dir):
    """S3: contracts of a snapshot by days to expiry; deliverables other than 100 shares, or unreadable ones, are out."""
    li = table(spark, sf_dir, "lineitem")
    shares = F.when(F.col("l_quantity") % 3 != 0, "100").when(F.col("l_quantity") % 2 == 0, "none").otherwise("10")
    rows = li.select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("contract"), F.to_date("l_shipdate").alias("as_of"),
                     F.date_add(F.to_date("l_shipdate"), (F.col("l_partkey") % 200).cast("int")).alias("expiration_date"), shares.alias("shares_per_contract"))
    return rd.option_chain(rows, "as_of", 21, 45).drop("shares_per_contract")


@query("snapshot_csv", """SELECT lpad(c_custkey::VARCHAR, 10, '0') AS cik, replace(c_name, '#', '"#",') AS name, c_acctbal AS balance, CASE WHEN c_nationkey = 3 THEN NULL ELSE c_nationkey END AS nation FROM customer""")
def snapshot_csv(spark, sf_dir):
    """A CSV snapshot whose ids keep their zeros, with quotes, commas and empty cells."""
    c = table(spark, sf_dir, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("cik"), F.replace("c_name", F.lit("#"), F.lit('"#",')).alias("name"),
                                                F.col("c_acctbal").alias("balance"), F.when(F.col("c_nationkey") != 3, F.col("c_nationkey")).alias("nation"))
    at = _place(spark, "csv")
    c.write.option("header", True).option("escape", '"').csv(at)
    return rd.csv_table(spark, at, "cik STRING, name STRING, balance DOUBLE, nation INT")


@query("jsonl_errors", """SELECT event_id::VARCHAR AS key, 'row' AS kind, event_type AS detail FROM events WHERE event_id % 40 <> 7 AND event_id % 40 <> 8
UNION ALL SELECT event_id::VARCHAR, 'error', '{"event_id": ' || event_id || ', "event_type"' FROM events WHERE event_id % 40 = 7""")
def jsonl_errors(spark, sf_dir):
    """Good rows beside malformed lines, which keep their text; blank lines are skipped."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    cut = F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(', "event_type"'))
    line = F.when(F.col("event_id") % 40 == 7, cut).when(F.col("event_id") % 40 == 8, F.lit("   ")).otherwise(F.to_json(F.struct("event_id", "event_type")))
    rows, errors = rd.jsonl(spark, _lines(e.select(line.alias("value")), "jsonl"), "event_id BIGINT, event_type STRING")
    good = rows.select(F.col("event_id").cast("string").alias("key"), F.lit("row").alias("kind"), F.col("event_type").alias("detail"))
    return good.unionByName(errors.select(F.regexp_extract("line", r"(\d+)", 1).alias("key"), F.lit("error").alias("kind"), F.col("line").alias("detail")))


@query("manifest_scan", """WITH m AS (SELECT CASE WHEN doc_id % 50 = 1 THEN '' ELSE 'd:' || (doc_id - CASE WHEN doc_id % 50 = 3 THEN 1 ELSE 0 END) END AS id, doc_id FROM documents)
SELECT id AS key, 'id_and_path_required' AS reason FROM m WHERE id = '' AND doc_id % 50 <> 9 UNION ALL SELECT '{"document_id": "d:' || doc_id AS key, 'malformed_line' FROM m WHERE doc_id % 50 = 9
UNION ALL SELECT id, 'duplicate_document_id' FROM m WHERE doc_id % 50 <> 9 GROUP BY 1 HAVING count(*) > 1""")
def manifest_scan(spark, sf_dir):
    """Violations of a landed manifest: missing ids, malformed lines, duplicate ids."""
    k = F.col("doc_id") % 50
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    ident = F.when(k == 1, "").otherwise(F.concat(F.lit("d:"), (F.col("doc_id") - F.when(k == 3, 1).otherwise(0)).cast("string")))
    good = F.to_json(F.struct(ident.alias("document_id"), F.concat_ws("/", F.coalesce("source", F.lit("none")), "doc_id").alias("source_path"), F.col("h").alias("source_sha256")))
    line = F.when(k == 9, F.concat(F.lit('{"document_id": "d:'), F.col("doc_id").cast("string"))).otherwise(good)
    return rd.manifest(spark, _lines(d.select(line.alias("value")), "manifest"))[1]


@query("strict_pages", """SELECT conv_id, count(*)::INT AS turns, max(length(text)) AS longest FROM conversations GROUP BY 1""")
def strict_pages(spark, sf_dir):
    """JSON documents read strictly, one page of conversations a file."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").cast("int").alias("turns"), F.max(F.length("text")).alias("longest"))
    at = _pages(c, "strict", F.col("conv_id"), F.struct("conv_id", "turns", "longest"))
    return rd.strict_json(spark, at, "results ARRAY<STRUCT<conv_id: BIGINT, turns: INT, longest: INT>>").select(F.inline("results"))


@query("dictionary_csv", """SELECT upper(word) AS word, category FROM (SELECT word, unnest(['negative', 'positive', 'uncertainty']) AS category, unnest([length(word) % 3, length(word) % 2, 1]) AS v
  FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{3,9}')) AS word FROM benchmark)) WHERE v > 0""")
def dictionary_csv(spark, sf_dir):
    """Memberships of a landed dictionary; words of the benchmark, categories by their length."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{3,9}"), F.lit(0))).alias("Word")).distinct()
    at = _place(spark, "dictionary")
    words.select("Word", (F.length("Word") % 3).alias("Negative"), (F.length("Word") % 2).alias("Positive"), F.lit(1).alias("Uncertainty")).write.option("header", True).csv(at)
    return rd.dictionary(spark, at, ["Negative", "Positive", "Uncertainty"])


@query("filers_with_form", """SELECT DISTINCT lpad(o_custkey::VARCHAR, 10, '0') AS cik FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def filers_with_form(spark, sf_dir):
    """Distinct filers that hold one of two forms."""
    form = F.when(F.col("o_orderpriority") == "1-URGENT", "8-K").when(F.col("o_orderpriority") == "2-HIGH", "8-K/A").otherwise("10-Q")
    return rd.filers_with_form(table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("company"), form.alias("form")))


@query("issuer_metadata", """SELECT lpad(s_suppkey::VARCHAR, 10, '0') AS cik, s_name AS name, CASE WHEN s_nationkey % 5 = 0 THEN NULL ELSE (1000 + s_nationkey)::VARCHAR END AS sic, 'Nation ' || s_nationkey AS sic_description FROM supplier""")
def issuer_metadata(spark, sf_dir):
    """Four fields of one document per issuer, many documents a file; padding is trimmed, other members are not read."""
    s = table(spark, sf_dir, "supplier")
    body = F.to_json(F.struct(F.col("s_suppkey").cast("string").alias("cik"), F.concat(F.lit(" "), "s_name", F.lit("  ")).alias("name"), F.when(F.col("s_nationkey") % 5 != 0, (F.col("s_nationkey") + 1000).cast("string")).alias("sic"),
                              F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string"), F.lit(" ")).alias("sicDescription"), F.array(F.lit(1), F.lit(2)).alias("filings")))
    return rd.issuer_metadata(spark, _arrays(s.select("s_suppkey", body.alias("value")), "issuers", "s_suppkey", DOCUMENTS))


@query("award_rows", """SELECT p_brand AS recipient_name, 'A' || p_partkey AS award_id, '' AS start_date, '' AS end_date, CASE WHEN p_size % 4 = 0 THEN 0 ELSE p_retailprice END AS award_amount, p_type AS awarding_agency,
  '' AS awarding_sub_agency, p_name || ' second line' AS description, p_partkey::VARCHAR AS usaspending_internal_id FROM part""")
def award_rows(spark, sf_dir):
    """Award pages with missing members and line feeds in descriptions."""
    row = F.struct(F.concat(F.lit("A"), F.col("p_partkey").cast("string")).alias("Award ID"), F.col("p_brand").alias("Recipient Name"), F.when(F.col("p_size") % 4 != 0, F.col("p_retailprice")).alias("Award Amount"),
                   F.col("p_type").alias("Awarding Agency"), F.concat("p_name", F.lit("\nsecond line\n")).alias("Description"), F.col("p_partkey").cast("string").alias("generated_internal_id"))
    return rd.award_pages(spark, _pages(table(spark, sf_dir, "part"), "awards", F.col("p_partkey"), row))


@query("acceptance_headers", """SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate::DATE + to_minutes((o_custkey % 1440)::INT) END AS accepted_at FROM orders""")
def acceptance_headers(spark, sf_dir):
    """Acceptance stamps out of landed header texts; a header without one gives null."""
    minutes = F.col("o_custkey") % 1440
    stamp = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lpad(F.floor(minutes / 60).cast("string"), 2, "0"), F.lpad((minutes % 60).cast("string"), 2, "0"), F.lit("00"))
    text = F.concat(F.lit("<SEC-HEADER>"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 11 != 0, F.concat(F.lit(" <ACCEPTANCE-DATETIME>"), stamp)).otherwise(""))
    at = _lines(table(spark, sf_dir, "orders").select(text.alias("value")), "headers")
    return rd.acceptance_time(spark.read.text(at)).select(F.regexp_extract("value", r"(\d+)", 1).cast("bigint").alias("o_orderkey"), "accepted_at")


@query("stored_bodies", """WITH b AS (SELECT o_custkey // 50 AS page, '{"page":' || (o_custkey // 50) || ',"keys":"' || string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) || '"}' AS body, count(*) AS n FROM orders GROUP BY 1)
SELECT page, length(body) + 1 AS length, sha256(body || chr(10)) AS sha256, n::INT AS n_keys, '.txt' AS extension FROM b""")
def stored_bodies(spark, sf_dir):
    """Stored response bodies with size, digest and file kind, and a typed view over their bytes."""
    o = table(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_custkey") / 50).alias("page")).agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")).cast("array<string>"), ",").alias("keys"))
    at = _documents(o.select("page", F.to_json(F.struct("page", "keys")).alias("value")), "bodies", "page")
    files = rd.hashed_files(spark, at)
    typed = rd.json_over_bytes(files, "page BIGINT, keys STRING").select("path", "body.page", F.size(F.split("body.keys", ",")).alias("n_keys"))
    kinds = rd.file_inventory(spark, at).select("path", "extension")
    return files.select("path", "length", "sha256").join(typed, "path").join(kinds, "path").drop("path")


@query("study_rows", """SELECT '{"key": "' || c_custkey || '", "segment": "' || c_mktsegment || '", "balance": "' || c_acctbal || '"}' AS row FROM customer WHERE c_acctbal <> 0""")
def study_rows(spark, sf_dir):
    """Every CSV row as a map of strings, its fields read by name."""
    at = _place(spark, "study")
    table(spark, sf_dir, "customer").where("c_acctbal <> 0").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").cast("decimal(18,2)").cast("double").alias("balance")).write.option("header", True).csv(at)
    d = F.col("row_data")
    return rd.study_rows(spark, at, ["key", "segment", "balance"]).select(F.concat(F.lit('{"key": "'), d["key"], F.lit('", "segment": "'), d["segment"], F.lit('", "balance": "'), d["balance"], F.lit('"}')).alias("row"))


@query("registration_rows", """SELECT 'n' || n_nationkey AS folder, CASE WHEN n_nationkey % 6 <> 5 THEN n_name END AS source_id, CASE WHEN n_nationkey % 6 <> 5 THEN 'R' || n_regionkey END AS owner, n_nationkey % 6 = 5 AS unreadable FROM nation""")
def registration_rows(spark, sf_dir):
    """One registration per source folder; an unreadable one stays as a row with its text."""
    n = table(spark, sf_dir, "nation")
    good = F.to_json(F.struct(F.lit("1").alias("schema_version"), F.col("n_name").alias("source_id"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("owner")))
    rows = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("source"), F.when(F.col("n_nationkey") % 6 == 5, F.lit("{not json")).otherwise(good).alias("value"))
    r = rd.registrations(spark, _documents(rows, "registrations", "source"))
    return r.select(F.regexp_extract("file_path", "source=([^/]+)", 1).alias("folder"), "source_id", "owner", F.col("_bad").isNotNull().alias("unreadable"))


@query("ledger_lines", """SELECT 's' || (o_custkey % 20) AS ledger, row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) - 1 AS line_order, 'order ' || o_orderkey AS line FROM orders""")
def ledger_lines(spark, sf_dir):
    """Exact line texts and their order in landed ledgers, blank lines left out."""
    o = table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("s"), (F.col("o_custkey") % 20).cast("string")).alias("ledger")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("k"))
    text = F.array_join(F.transform("k", lambda x: F.concat(F.lit("order "), x.cast("string"))), "\n")
    at = _documents(o.select("ledger", F.concat(text, F.lit("\n\n")).alias("value")), "ledgers", "ledger")
    return rd.ledger(spark, at).select(F.regexp_extract("file_path", "ledger=([^/]+)", 1).alias("ledger"), F.col("seq").cast("bigint").alias("line_order"), "line")


@query("taxonomy_family", """SELECT DISTINCT p_brand AS primary_category, p_type AS secondary_category, p_name AS tertiary_category FROM part WHERE p_type IN (SELECT p_type FROM part WHERE p_name = (SELECT min(p_name) FROM part))""")
def taxonomy_family(spark, sf_dir):
    """Every tag of the family that the first tag belongs to."""
    t = table(spark, sf_dir, "part").select(F.col("p_brand").alias("primary_category"), F.col("p_type").alias("secondary_category"), F.col("p_name").alias("tertiary_category")).distinct()
    return rd.taxonomy_family(t, t.agg(F.min("tertiary_category")).first()[0])


@query("replaced_runs", """SELECT o_orderstatus AS run_id, o_orderkey, o_totalprice + CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS price FROM orders WHERE o_orderstatus <> 'F' OR o_orderkey % 2 = 0""")
def replaced_runs(spark, sf_dir):
    """K4: rows of a run replace that run as a whole, other runs stay."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("run_id"), "o_orderkey", F.col("o_totalprice").alias("price"))
    at = _place(spark, "runs")
    sinks.replace_runs(o, at)
    sinks.replace_runs(o.where("run_id = 'F' AND o_orderkey % 2 = 0").withColumn("price", F.col("price") + 1), at)
    return spark.read.schema(o.schema).parquet(at)


@query("upserted_rows", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'changed' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS version FROM customer UNION ALL SELECT -1 - s_suppkey, 'new', 2 FROM supplier""")
def upserted_rows(spark, sf_dir):
    """The latest version per key after changes and additions."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.lit(1).alias("version"))
    new = table(spark, sf_dir, "supplier").select((-1 - F.col("s_suppkey")).alias("c_custkey"), F.lit("new").alias("segment"), F.lit(2).alias("version"))
    return sinks.upsert(c, c.where("c_custkey % 3 = 0").withColumns({"segment": F.lit("changed"), "version": F.lit(2)}).unionByName(new), ["c_custkey"], "version")


@query("nested_companies", """SELECT c_custkey AS company, count(o_orderkey) AS filings, min(o_orderdate::DATE) AS first_date FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def nested_companies(spark, sf_dir):
    """K5: one JSON object per company with its totals, read back from what was written."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    g = c.groupBy(F.col("c_custkey").alias("company")).agg(F.struct(F.count("o_orderkey").alias("filings"), F.min(F.to_date("o_orderdate")).alias("first_date")).alias("totals"))
    at = _place(spark, "nested")
    sinks.write_nested(g, at)
    return spark.read.schema(g.schema).json(at).select("company", "totals.filings", "totals.first_date")
