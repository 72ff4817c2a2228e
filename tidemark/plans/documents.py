"""Document queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as fn, text as tx
from ..operators import asof, documents as dc, intervals as iv, wording as wd
from ..staging import stage
from .registry import query, table
from .study import rounded

WS = "[" + fn.WHITESPACE + "]"
MARK = "chr(64976)"
STATEMENTS_CTE = f"""
pc AS (SELECT doc_id, source, lang, sha256(text) AS digest, string_split(regexp_replace(regexp_replace(text, '([.!?])({WS})', '\\1' || {MARK} || '\\2', 'g'), '([\\n\\f])', '\\1' || {MARK}, 'g'), {MARK}) AS ps FROM documents),
pu AS (SELECT doc_id, source, lang, digest, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM pc),
po AS (SELECT *, coalesce(sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off, regexp_replace(p, '^{WS}+', '') AS body FROM pu),
sp AS (SELECT doc_id, source, lang, digest, (off + length(p) - length(body))::INT AS char_start, regexp_replace(body, '{WS}+$', '') AS quoted_text FROM po),
stm AS (SELECT *, (char_start + length(quoted_text))::INT AS char_end FROM sp WHERE quoted_text <> '')
"""


@query("sentences", f"""WITH {STATEMENTS_CTE} SELECT sha256(doc_id || ':' || digest || ':' || char_start || ':' || char_end) AS evidence_id, doc_id AS document_id, digest AS text_sha256, doc_id || ':document' AS section_id,
  NULL::VARCHAR AS sec_item, char_start, char_end, quoted_text, 'statement' AS record_type FROM stm""")
def sentences(spark, sf_dir):
    """F5, F6, F10, W6, W7."""
    return tx.statements(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("text_rows", f"""WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '(\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}])', '\\1' || {MARK}, 'g'), {MARK}) AS ps FROM documents),
u AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM l),
o AS (SELECT *, coalesce(sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS off, regexp_replace(p, '[\\r\\n\\f]+$', '') AS v FROM u),
k AS (SELECT * FROM o WHERE len(regexp_split_to_array(v, '\\t| {{2,}}')) > 1 AND regexp_replace(v, '{WS}+', '', 'g') <> '')
SELECT doc_id AS document_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS row_index, off AS char_start, (off + length(v))::INT AS char_end, regexp_split_to_array(v, '\\t| {{2,}}') AS cells FROM k""")
def text_rows(spark, sf_dir):
    """S11."""
    return tx.text_rows(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("html_text")
def html_text(spark, sf_dir):
    """S10, K7."""
    return tx.html_text(table(spark, sf_dir, "pages"), "page_id", "html")


# A small word list for the provided prose.
WORDS = [("THE", "positive"), ("AND", "positive"), ("THAT", "uncertainty"), ("WAS", "uncertainty"), ("FOR", "positive"), ("THOU", "weak_modal"), ("LE", "negative"), ("DES", "negative"),
         ("DER", "negative"), ("UND", "negative"), ("QUE", "litigious"), ("EN", "constraining"), ("WHICH", "strong_modal"), ("OF", "strong_modal")]
VALUES = ", ".join(f"('{w}', '{c}')" for w, c in WORDS)
DICT_CTE = f"""dict(word, category) AS (VALUES {VALUES}),
tok AS (SELECT doc_id, source, regexp_extract_all(upper(replace(text, 'ß', 'SS')), '[A-Za-z]+(?:''[A-Za-z]+)?') AS w FROM documents),
cnt AS (SELECT doc_id, {", ".join(f"count(*) FILTER (category = '{c}') AS n_{c}" for c in wd.CATEGORIES)} FROM (SELECT doc_id, unnest(w) AS word FROM tok) JOIN dict USING (word) GROUP BY 1),
sc AS (SELECT doc_id, source, len(w) AS word_count, {", ".join(f"coalesce(n_{c}, 0) AS n_{c}" for c in wd.CATEGORIES)} FROM tok LEFT JOIN cnt USING (doc_id))"""
RATES = [f"rate_{c}" for c in wd.CATEGORIES]


def scored(spark, sf_dir):
    words = spark.createDataFrame(WORDS, "word STRING, category STRING")
    return wd.dictionary_counts(table(spark, sf_dir, "documents"), ["doc_id", "source"], "text", words)


@query("dict_rates", f"""WITH {DICT_CTE} SELECT doc_id, source, word_count::INT AS word_count, {", ".join(f"n_{c}::INT AS n_{c}, round(n_{c} / nullif(word_count, 0), 8) AS rate_{c}" for c in wd.CATEGORIES)} FROM sc""")
def dict_rates(spark, sf_dir):
    """F7, A18."""
    return rounded(scored(spark, sf_dir), RATES, 8)


@query("section_rollup", f"""WITH {DICT_CTE} SELECT source, sum(word_count)::BIGINT AS word_count, {", ".join(f"sum(n_{c})::BIGINT AS n_{c}, round(sum(n_{c}) / sum(word_count), 8) AS rate_{c}" for c in wd.CATEGORIES)} FROM sc GROUP BY 1""")
def section_rollup(spark, sf_dir):
    """A19."""
    return rounded(wd.section_rollup(scored(spark, sf_dir), ["source"]), RATES, 8)


@query("dup_content", """WITH h AS (SELECT doc_id, sha256(text) AS s FROM documents), f AS (SELECT s, min(doc_id) AS f FROM h GROUP BY 1)
SELECT doc_id AS document_id, s AS sha256, CASE WHEN doc_id > f THEN f END AS duplicate_of FROM h JOIN f USING (s)""")
def dup_content(spark, sf_dir):
    """J35."""
    return dc.duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


# The reference engine measures edit distance in bytes: give each accented letter of the test prose one spare byte.
ACCENTS = "ÉßÑÈÍéèêíçÇóÓöüÖñÊÄäÜ"
BYTES = " || ".join(f"chr({c})" for c in [*range(2, 9), *range(14, 28)])
NOVELTY = f"""WITH {STATEMENTS_CTE},
cur AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY char_start) - 1 AS pos, translate(regexp_replace(quoted_text, '{WS}+', ' ', 'g'), '{ACCENTS}', {BYTES}) AS t FROM stm),
pf AS (SELECT doc_id, lag(doc_id) OVER (PARTITION BY source, lang ORDER BY doc_id) AS prior_id FROM documents),
pr AS (SELECT c.doc_id, c.pos, p.pos AS prior_pos, 1 - levenshtein(c.t, p.t) / greatest(length(c.t), length(p.t)) AS s FROM cur c JOIN pf USING (doc_id) JOIN cur p ON p.doc_id = pf.prior_id),
best AS (SELECT doc_id, pos, max(s) AS similarity, arg_max(prior_pos, (s, -prior_pos)) AS prior_pos FROM pr GROUP BY ALL)
SELECT c.doc_id, prior_id, c.pos::INT AS pos, round(coalesce(similarity, 0), 6) AS similarity, CASE WHEN similarity = 1 THEN 'unchanged' WHEN similarity >= 0.65 THEN 'changed' ELSE 'new_statement' END AS novelty,
  CASE WHEN similarity >= 0.65 THEN prior_pos END::INT AS prior_pos
FROM cur c JOIN pf USING (doc_id) LEFT JOIN best b USING (doc_id, pos) WHERE prior_id IS NOT NULL"""


def filing_pairs(spark, sf_dir):
    """Every document with the previous one of its (source, language), by id only."""
    d = table(spark, sf_dir, "documents")
    f = d.select(F.concat_ws("/", "source", "lang").alias("issuer"), F.timestamp_seconds(F.col("doc_id") * 86400).alias("at"), "doc_id")
    return wd.prior_filing(f, "issuer", "at", ["doc_id"]).where("prior_doc_id IS NOT NULL").select("doc_id", F.col("prior_doc_id").alias("prior_id"))


@query("novelty_best", NOVELTY)
def novelty_best(spark, sf_dir):
    """J31, J32, F9."""
    pairs = stage(filing_pairs(spark, sf_dir), "pairs")
    return rounded(wd.best_prior_filing(table(spark, sf_dir, "documents").select("doc_id", "text"), pairs, tx.statement_array(F.col("text"))), ["similarity"])


@query("span_weight_signal", """WITH s AS (SELECT conv_id, length(text) AS w, CASE role WHEN 'user' THEN 0.2::DOUBLE WHEN 'assistant' THEN 0.1::DOUBLE ELSE 0.3::DOUBLE END AS neg,
  CASE role WHEN 'user' THEN 0.3::DOUBLE WHEN 'assistant' THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END AS pos FROM conversations)
SELECT conv_id, sum(w)::BIGINT AS covered_characters, count(*) AS fragments, round(sum(w * (pos - neg)) / sum(w), 8) AS signal, CASE WHEN bool_or(w <= 0) THEN 'full_span_fragment_bounds' END AS reason FROM s GROUP BY 1""")
def span_weight_signal(spark, sf_dir):
    """Turns as spans, role probabilities, length as weight."""
    neg = F.when(F.col("role") == "user", 0.2).when(F.col("role") == "assistant", 0.1).otherwise(0.3)
    pos = F.when(F.col("role") == "user", 0.3).when(F.col("role") == "assistant", 0.6).otherwise(0.3)
    c = table(spark, sf_dir, "conversations").select("conv_id", F.lit(0).alias("a"), F.length("text").alias("z"), neg.alias("neg"), pos.alias("pos")).withColumn("neu", 1 - F.col("neg") - F.col("pos"))
    return rounded(wd.weighted_signal(c, ["conv_id"], "a", "z", "neg", "neu", "pos"), ["signal"], 8)


@query("page_offsets", """SELECT conv_id, turn, (coalesce(sum(length(text) + 3) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS char_start,
  (coalesce(sum(length(text) + 3) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(text))::BIGINT AS char_end FROM conversations""")
def page_offsets(spark, sf_dir):
    """Turns as saved pages joined by a three-character separator."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"), (F.length("text") + 3).alias("step"))
    r = asof.running_total(c, ["conv_id"], ["turn"], "step", "total", F.floor(F.col("turn") / 1000))
    return r.select("conv_id", "turn", (F.col("total") - F.col("step")).alias("char_start"), (F.col("total") - 3).alias("char_end"))


@query("page_confidence", """WITH w AS (SELECT conv_id, turn, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda x: length(x) * 12.5::DOUBLE), lambda v: v <= 100) AS c FROM conversations)
SELECT conv_id, turn, CASE WHEN len(c) > 0 THEN round(list_sum(c) / len(c), 8) END AS confidence FROM w""")
def page_confidence(spark, sf_dir):
    """A31."""
    conf = F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), lambda x: F.length(x) * 12.5)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(dc.page_confidence(conf), 8).alias("confidence"))


@query("span_pages", f"""WITH {STATEMENTS_CTE}, pg AS (SELECT doc_id, i AS page_number, i * 1000 AS ps, least((i + 1) * 1000, length(text)) AS pe FROM documents, range(100) t(i) WHERE i * 1000 < length(text))
SELECT s.doc_id AS document_id, char_start, char_end, page_number::INT AS page_number, (ps <= char_start AND char_end <= pe) AS contained FROM stm s JOIN pg USING (doc_id) WHERE char_start < pe AND ps < char_end""")
def span_pages(spark, sf_dir):
    """Statements against 1000-character pages, overlap and containment."""
    d = table(spark, sf_dir, "documents")
    n = F.length("text")
    pages = d.where(n > 0).select(F.col("doc_id").alias("document_id"), F.explode(F.sequence(F.lit(0), F.floor((n - 1) / 1000).cast("int"))).alias("page_number"), n.alias("n"))
    pages = pages.select("document_id", "page_number", (F.col("page_number") * 1000).alias("ps"), F.least((F.col("page_number") + 1) * 1000, F.col("n")).alias("pe"))
    s = tx.statements(d, "doc_id", "text").select("document_id", "char_start", "char_end")
    j = iv.overlap_join(s, pages, ["document_id"], "char_start", "char_end", "ps", "pe", 1000)
    return j.select("document_id", "char_start", "char_end", "page_number", iv.contained(F.col("char_start"), F.col("char_end"), F.col("ps"), F.col("pe")).alias("contained"))


@query("span_gaps", f"""WITH {STATEMENTS_CTE}, g AS (SELECT doc_id, char_start, char_end, lag(char_end) OVER (PARTITION BY doc_id ORDER BY char_start, char_end) AS pe FROM stm)
SELECT doc_id AS document_id, char_start, char_end, coalesce(pe > char_start, false) AS overlap, greatest(char_start - coalesce(pe, 0), 0)::INT AS gap FROM g""")
def span_gaps(spark, sf_dir):
    """W8, J38."""
    s = tx.statements(table(spark, sf_dir, "documents"), "doc_id", "text").select("document_id", "char_start", "char_end")
    return iv.span_checks(s, ["document_id"], "char_start", "char_end")


SUBS_CTE = """subs AS (SELECT doc_id AS cik, lpad(doc_id::VARCHAR, 10, '0') || '-24-000001' AS accession, '<SEC-DOCUMENT>' || '<DOCUMENT>' || chr(10) || '<TYPE>' || CASE lang WHEN 'en' THEN '8-K' ELSE '10-Q' END || chr(10) || '<FILENAME>main.htm' || chr(10)
  || '<TEXT><p>Item 2.02 See Exhibit 99.1 and Exhibit 99.2</p>' || text || '</TEXT>' || '</DOCUMENT>' || '<DOCUMENT>' || chr(10) || '<TYPE>EX-99.1' || chr(10) || CASE WHEN n_chars > 1000 THEN '<FILENAME>ex.htm' || chr(10) ELSE '' END
  || '<TEXT>Quarterly results: revenue ' || source || '</TEXT></DOCUMENT>' AS payload FROM documents),
blk AS (SELECT lpad(cik::VARCHAR, 10, '0') AS cik, accession, unnest(b) AS block, generate_subscripts(b, 1) - 1 AS sequence FROM (SELECT *, regexp_extract_all(payload, '(?is)<DOCUMENT>\\s*(.*?)</DOCUMENT>', 1) AS b FROM subs)),
inv AS (SELECT cik, accession, sequence::INT AS sequence, upper(trim(regexp_extract(block, '(?i)<TYPE>[^\\S\\r\\n]*([^\\r\\n<]*)', 1))) AS kind, nullif(trim(regexp_extract(block, '(?i)<FILENAME>[^\\S\\r\\n]*([^\\r\\n<]*)', 1)), '') AS filename,
  regexp_extract_all(block, '(?is)<TEXT>(.*?)</TEXT>', 1)[1] AS content FROM blk)"""


def submissions(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    nl = F.lit("\n")
    payload = F.concat(F.lit("<SEC-DOCUMENT><DOCUMENT>\n<TYPE>"), F.when(F.col("lang") == "en", "8-K").otherwise("10-Q"), F.lit("\n<FILENAME>main.htm\n<TEXT><p>Item 2.02 See Exhibit 99.1 and Exhibit 99.2</p>"), "text",
                       F.lit("</TEXT></DOCUMENT><DOCUMENT>\n<TYPE>EX-99.1\n"), F.when(F.col("n_chars") > 1000, F.concat(F.lit("<FILENAME>ex.htm"), nl)).otherwise(""),
                       F.lit("<TEXT>Quarterly results: revenue "), "source", F.lit("</TEXT></DOCUMENT>"))
    return d.select(F.col("doc_id").alias("cik"), F.concat(F.lpad(F.col("doc_id").cast("string"), 10, "0"), F.lit("-24-000001")).alias("accession"), payload.alias("payload"))


@query("submission_inventory", f"""WITH {SUBS_CTE} SELECT cik, accession, sequence, cik || ':' || accession || ':' || coalesce(filename, 'missing_filename:' || kind) AS document_id, kind, filename,
  CASE WHEN kind = '8-K' THEN 'primary_filing' WHEN kind LIKE 'EX-99%' THEN 'earnings_release' ELSE 'unclassified' END AS document_role, CASE WHEN filename IS NULL THEN 'missing_filename' ELSE 'complete' END AS inventory_status,
  CASE WHEN kind = '8-K' THEN 1 ELSE 0 END AS items, sha256(content) AS source_sha256 FROM inv""")
def submission_inventory(spark, sf_dir):
    """Containers assembled from the documents table."""
    i = dc.inventory(submissions(spark, sf_dir), "cik", "accession", "payload")
    return i.select("cik", "accession", "sequence", "document_id", "kind", "filename", "document_role", "inventory_status", F.size("sec_items").alias("items"), "source_sha256")


@query("missing_exhibits", f"WITH {SUBS_CTE} SELECT cik, accession, '99.2' AS exhibit FROM inv WHERE kind = '8-K'")
def missing_exhibits(spark, sf_dir):
    """J36, T9."""
    return dc.missing_exhibits(dc.inventory(submissions(spark, sf_dir), "cik", "accession", "payload"))


@query("filing_extent", """SELECT source, CASE WHEN bool_and(n_chars IS NOT NULL) THEN min(doc_id) END AS earliest, CASE WHEN bool_and(n_chars IS NOT NULL) THEN max(doc_id) END AS latest FROM documents GROUP BY 1""")
def filing_extent(spark, sf_dir):
    """A38."""
    d = table(spark, sf_dir, "documents").withColumn("public_at", F.timestamp_seconds("doc_id"))
    return dc.comparison_metadata(d, ["source"], "doc_id", "public_at", F.col("n_chars").isNotNull())


READY = """i AS (SELECT o_custkey AS customer, o_orderkey AS document_id, o_orderpriority AS accession, CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'verified' END AS identity_status,
  CASE o_orderstatus WHEN 'O' THEN 'complete' WHEN 'F' THEN 'retrieved' ELSE 'incomplete_text' END AS inventory_status, o_orderdate AS public_at, CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' ELSE 'archive' END AS public_evidence,
  CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS received_at FROM orders),
t AS (SELECT l_orderkey AS document_id, max(l_shipdate) AS processed_at, max(l_linestatus) AS normalized_text FROM lineitem WHERE l_quantity > 5 GROUP BY 1),
r AS (SELECT customer, unnest([CASE WHEN identity_status <> 'verified' THEN 'submission_identity_unverified' END, CASE WHEN inventory_status NOT IN ('complete', 'available', 'retrieved', 'ok') THEN 'document_coverage_incomplete' END,
  CASE WHEN trim(coalesce(normalized_text, '')) = '' THEN 'document_text_missing' END, CASE WHEN accession = '1-URGENT' THEN 'target_filing_leakage' END,
  CASE WHEN public_evidence = 'unknown' THEN 'public_timestamp_unverified' WHEN public_at >= DATE '1997-01-01' THEN 'public_after_decision' END,
  CASE WHEN received_at IS NULL THEN 'receipt_timestamp_unavailable' WHEN received_at > DATE '1997-01-01' THEN 'receipt_after_decision' END,
  CASE WHEN processed_at IS NULL THEN 'processing_timestamp_unavailable' WHEN processed_at > DATE '1997-01-01' THEN 'processing_after_decision' END]) AS code FROM i LEFT JOIN t USING (document_id))"""


@query("readiness_reasons", f"""WITH {READY} SELECT customer, coalesce(string_agg(DISTINCT code, ',' ORDER BY code), '') AS reason_codes FROM r GROUP BY 1""")
def readiness_reasons(spark, sf_dir):
    """Orders as an inventory of customers, line items as transcripts."""
    o, n = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").where("l_quantity > 5")
    inventory = o.select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("document_id"), F.col("o_orderpriority").alias("accession"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("verified").alias("identity_status"),
                         F.when(F.col("o_orderstatus") == "O", "complete").when(F.col("o_orderstatus") == "F", "retrieved").otherwise("incomplete_text").alias("inventory_status"), F.col("o_orderdate").alias("public_at"),
                         F.when(F.col("o_orderkey") % 7 == 0, "unknown").otherwise(F.lit("archive")).alias("public_evidence"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderdate")).alias("received_at"))
    transcripts = n.groupBy(F.col("l_orderkey").alias("document_id")).agg(F.max("l_shipdate").alias("processed_at"), F.max("l_linestatus").alias("normalized_text"))
    r = dc.readiness(inventory, transcripts, "customer", F.lit("1997-01-01").cast("timestamp"), True, F.lit("1-URGENT"))
    return r.select("customer", F.array_join("reason_codes", ",").alias("reason_codes"))
