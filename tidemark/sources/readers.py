"""Scans of landed files (S1-S8, S13-S16, S18-S24). Schemas are explicit; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as fn

DISCLOSURE = ("accession_number STRING, cik STRING, filing_date DATE, filing_url STRING, primary_category STRING, "
              "secondary_category STRING, supporting_text STRING, tertiary_category STRING, tickers ARRAY<STRING>")
EVENTS = "cik STRING, accession_number STRING, ticker STRING, event_date DATE, t_pre DATE, t_0 DATE"
OPTION_LEGS = ("event_id STRING, bucket STRING, leg_code STRING, contract_ticker STRING, underlying_ticker STRING, "
               "contract_type STRING, strike DOUBLE, expiration_date DATE, selection_date DATE, spot_pre DOUBLE, "
               "shares_per_contract INT")
OPTION_BARS = "contract_ticker STRING, session DATE, close DOUBLE, volume DOUBLE"
BACKTEST = ("date DATE, portfolio_value DOUBLE, daily_pnl DOUBLE, transaction_costs DOUBLE, portfolio_return DOUBLE, "
            "gross_exposure DOUBLE, margin_used DOUBLE, cash DOUBLE, soybeans_signal DOUBLE, soybeans_position DOUBLE")
MANIFEST_ROW = "document_id STRING, source_path STRING, source_url STRING, source_sha256 STRING"


def pages(spark: SparkSession, path: str, row_schema: str) -> DataFrame:
    """Landed API pages, one JSON document each, flattened to result rows."""
    schema = f"results ARRAY<STRUCT<{_colons(row_schema)}>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("results"))


def _colons(ddl: str) -> str:
    return ", ".join(f"{name}: {dtype}" for name, dtype in
                     ((f.name, f.dataType.simpleString()) for f in T.StructType.fromDDL(ddl)))


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Header CSV with forced types and doubled quotes inside quoted cells; malformed rows fail the job."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("mode", "FAILFAST").csv(path)


def strict_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents; NaN/Infinity tokens and malformed input are refused."""
    return (spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST")
            .option("allowNonNumericNumbers", False).json(path))


def jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors); blank lines skipped, malformed lines kept with their text and file."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file_path"))
    text = text.where(F.length(F.trim("value")) > 0)
    parsed = text.withColumn("r", F.from_json("value", schema + ", _bad STRING",
                                              {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    names = T.StructType.fromDDL(schema).names
    rows = parsed.where("r._bad IS NULL").select(*[f"r.{n}" for n in names], "file_path")
    errors = parsed.where("r._bad IS NOT NULL").select("file_path", F.col("value").alias("line"))
    return rows, errors


def manifest(spark: SparkSession, path: str, unique_documents: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, violations) of a document manifest; an empty manifest is itself a violation."""
    rows, errors = jsonl(spark, path, MANIFEST_ROW)
    missing = rows.where("coalesce(document_id, '') = '' OR coalesce(source_path, '') = ''").select(
        F.coalesce("document_id", F.lit("")).alias("key"), F.lit("id_and_path_required").alias("reason"))
    bad = errors.select(F.col("line").alias("key"), F.lit("malformed_line").alias("reason"))
    empty = rows.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("").alias("key"), F.lit("empty_manifest").alias("reason"))
    out = missing.unionByName(bad).unionByName(empty)
    if unique_documents:
        dup = rows.groupBy("document_id").count().where("count > 1").select(
            F.col("document_id").alias("key"), F.lit("duplicate_document_id").alias("reason"))
        out = out.unionByName(dup)
    return rows, out


def option_chain(snapshot: DataFrame, as_of_col: str, dte_lo: int, dte_hi: int) -> DataFrame:
    """S3: contracts listed on the snapshot day, expiring lo..hi days later, standard multiplier only."""
    return (snapshot.withColumn("dte", F.datediff("expiration_date", as_of_col))
            .where((F.col("shares_per_contract").cast("string").try_cast("double") == 100)
                   & F.col("dte").between(dte_lo, dte_hi)))


def bars_from_epoch(raw: DataFrame, keys: list[str]) -> DataFrame:
    """Epoch-millisecond bars to exchange sessions; a missing volume is zero."""
    local = F.from_utc_timestamp(F.timestamp_millis(F.col("t")), "America/New_York")
    return raw.select(*keys, F.to_date(local).alias("session"), F.col("c").cast("double").alias("close"),
                      F.coalesce(F.col("v").cast("double"), F.lit(0.0)).alias("volume"))


def dictionary(spark: SparkSession, path: str, categories: list[str]) -> DataFrame:
    """(word, category) memberships where the category value is positive."""
    schema = "Word STRING, " + ", ".join(f"`{c}` DOUBLE" for c in categories)
    wide = csv_table(spark, path, schema)
    return (wide.unpivot("Word", categories, "category", "value").where("value > 0")
            .select(F.upper("Word").alias("word"), F.lower("category").alias("category")).distinct())


def filers_with_form(catalog: DataFrame, forms: tuple[str, ...] = ("8-K", "8-K/A")) -> DataFrame:
    """Distinct zero-padded filers holding one of the forms."""
    return catalog.where(F.col("form").isin(*forms)).select(fn.zero_pad(F.col("company")).alias("cik")).distinct()


def issuer_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Four trimmed fields of large issuer documents (other members are never materialized)."""
    d = spark.read.schema("cik STRING, name STRING, sic STRING, sicDescription STRING").option("multiLine", True).json(path)
    return d.select(fn.zero_pad(F.col("cik")).alias("cik"), F.trim("name").alias("name"), F.trim("sic").alias("sic"),
                    F.trim("sicDescription").alias("sic_description"))


def award_pages(spark: SparkSession, path: str) -> DataFrame:
    """Award result rows with defaults; newlines in descriptions become blanks."""
    row = ("`Award ID`: string, `Recipient Name`: string, `Start Date`: string, `End Date`: string, "
           "`Award Amount`: double, `Awarding Agency`: string, `Awarding Sub Agency`: string, `Description`: string, "
           "`generated_internal_id`: string")
    r = spark.read.schema(f"results ARRAY<STRUCT<{row}>>").option("multiLine", True).json(path).select(F.inline("results"))
    text = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(""))
    return r.select(text("Recipient Name").alias("recipient_name"), text("Award ID").alias("award_id"),
                    text("Start Date").alias("start_date"), text("End Date").alias("end_date"),
                    F.coalesce(F.col("`Award Amount`"), F.lit(0.0)).alias("award_amount"),
                    text("Awarding Agency").alias("awarding_agency"),
                    text("Awarding Sub Agency").alias("awarding_sub_agency"),
                    F.trim(F.regexp_replace(text("Description"), "\n", " ")).alias("description"),
                    text("generated_internal_id").alias("usaspending_internal_id"))


def acceptance_time(headers: DataFrame, text: str = "value") -> DataFrame:
    """14-digit acceptance stamp (exchange-local wall time), NULL when absent."""
    digits = F.nullif(F.regexp_extract(text, r"<ACCEPTANCE-DATETIME>(\d{14})", 1), F.lit(""))
    return headers.withColumn("accepted_at", F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss")))


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Path, size and time of every file below root; contents are pruned from the scan."""
    f = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
         .select("path", "length", "modificationTime"))
    return f.withColumn("extension", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)))


def study_rows(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Each CSV row as a string map with its file."""
    d = csv_table(spark, path, ", ".join(f"`{c}` STRING" for c in columns))
    pairs = F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*[F.col(f"`{c}`") for c in columns]))
    return d.select(F.col("_metadata.file_path").alias("file_path"), pairs.alias("row_data"))


def hashed_files(spark: SparkSession, path: str) -> DataFrame:
    """Stored bytes with their digest."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return f.select("path", "length", F.sha2("content", 256).alias("sha256"), "content")


def json_over_bytes(files: DataFrame, schema: str) -> DataFrame:
    """Typed view over stored response bodies."""
    return files.select("path", F.from_json(F.decode("content", "UTF-8"), schema).alias("body"))


def registrations(spark: SparkSession, path: str) -> DataFrame:
    """One JSON per source folder; unreadable files stay as rows with their text."""
    schema = "schema_version STRING, source_id STRING, owner STRING, stage STRING, engine STRING, _bad STRING"
    return (spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)
            .withColumn("file_path", F.col("_metadata.file_path")))


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Exact line text and order of a hash-chained ledger (one file, line number within the file)."""
    body = spark.read.text(path, wholetext=True)
    lines = body.select(F.col("_metadata.file_path").alias("file_path"), F.posexplode(F.split("value", "\n")).alias("seq", "line"))
    return lines.where(F.length(F.trim("line")) > 0)


def taxonomy_counts(taxonomy: DataFrame) -> DataFrame:
    """Distinct tags per taxonomy level."""
    return taxonomy.agg(*[F.countDistinct(c).alias(c) for c in
                          ("primary_category", "secondary_category", "tertiary_category")])


def taxonomy_family(taxonomy: DataFrame, tag: str) -> DataFrame:
    """Every tag that shares the secondary family of `tag`."""
    fam = taxonomy.where(F.col("tertiary_category") == tag).select("secondary_category").distinct()
    return taxonomy.join(fam, "secondary_category", "left_semi")
