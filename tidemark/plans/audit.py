"""Audit queries. Roles: customers, orders and suppliers as exported tables; orders of a customer as a ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import gates, scalars as fn
from ..operators import audit as au
from ..operators.asof import running_total
from ..staging import stage
from .registry import query, table

# Columns of the provided tables by kind: i integer, s text, f double, t timestamp, v vector of floats.
COLUMNS = {
    "region": "r_regionkey i, r_name s", "nation": "n_nationkey i, n_name s, n_regionkey i",
    "customer": "c_custkey i, c_name s, c_nationkey i, c_acctbal f, c_mktsegment s", "supplier": "s_suppkey i, s_name s, s_nationkey i, s_acctbal f",
    "part": "p_partkey i, p_name s, p_brand s, p_type s, p_size i, p_retailprice f",
    "orders": "o_orderkey i, o_custkey i, o_orderstatus s, o_totalprice f, o_orderdate t, o_orderpriority s",
    "lineitem": "l_orderkey i, l_partkey i, l_suppkey i, l_linenumber i, l_quantity f, l_extendedprice f, l_discount f, l_tax f, l_returnflag s, l_linestatus s, l_shipdate t",
    "events": "event_id i, ts t, user_id i, event_type s, value f, props s", "documents": "doc_id i, text s, lang s, source s, n_chars i",
    "embeddings": "vec_id i, embedding v, label i", "pages": "page_id i, url s, html s", "benchmark": "item_id i, text s",
    "labels": "doc_id i, quality i, toxic i", "conversations": "conv_id i, turn i, role s, text s"}


def _encoded_sql(c: str, kind: str) -> str:
    number = lambda x, digits=12: f"'F' || CASE WHEN isnan({x}::DOUBLE) THEN 'NaN' WHEN isinf({x}::DOUBLE) THEN CASE WHEN {x} > 0 THEN 'Infinity' ELSE '-Infinity' END ELSE printf('%.{digits}e', {x}::DOUBLE + 0) END || ';'"
    out = {"i": f"'I' || {c} || ';'", "s": f"'S' || strlen({c}) || ':' || {c}", "f": number(c), "t": f"'T' || epoch_us({c}) || ';'",
           "v": f"'A' || len({c}) || ':' || coalesce(list_aggregate(list_transform({c}, lambda x: CASE WHEN x IS NULL THEN 'N' ELSE {number('x', 8)} END), 'string_agg', ''), '')"}[kind]
    return f"CASE WHEN {c} IS NULL THEN 'N' ELSE {out} END"


def content_sql(name: str, source: str | None = None) -> str:
    words = ", ".join(f"coalesce(sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT), 0)::BIGINT::VARCHAR" for i in range(8))
    row = " || ".join(f"'{len(c)}:{c}=' || {_encoded_sql(c, k)}" for c, k in sorted(x.split() for x in COLUMNS[name].split(", ")))
    return f"SELECT '{name}' AS table_name, count(*) AS rows, sha256(concat_ws('|', count(*)::VARCHAR, {words})) AS sha256 FROM (SELECT sha256({row}) AS h FROM {source or name})"


ALL_TABLES = " UNION ALL ".join(content_sql(t) for t in COLUMNS)


def tables(spark, sf_dir):
    return {t: table(spark, sf_dir, t) for t in COLUMNS}


@query("table_manifest", ALL_TABLES)
def table_manifest(spark, sf_dir):
    """All columns of all provided tables."""
    return au.manifest(tables(spark, sf_dir))


CHANGED = {"customer": "(SELECT * REPLACE (CASE WHEN c_custkey = 7 THEN 'X' ELSE c_name END AS c_name) FROM customer)", "lineitem": "(SELECT * REPLACE (l_tax + CASE WHEN l_orderkey % 100 = 1 THEN 0.01 ELSE 0 END AS l_tax) FROM lineitem)"}


@query("manifest_compare", f"""WITH a AS ({ALL_TABLES}), b AS ({" UNION ALL ".join(content_sql(t, CHANGED.get(t)) for t in COLUMNS if t != "labels")})
SELECT table_name, a.rows AS rows_a, b.rows AS rows_b, coalesce(a.sha256 = b.sha256, false) AS identical FROM a FULL JOIN b USING (table_name)""")
def manifest_compare(spark, sf_dir):
    """A run against one with a changed name, changed taxes and a missing table."""
    a = tables(spark, sf_dir)
    b = {t: d for t, d in a.items() if t != "labels"}
    b["customer"] = b["customer"].withColumn("c_name", F.when(F.col("c_custkey") == 7, "X").otherwise(F.col("c_name")))
    b["lineitem"] = b["lineitem"].withColumn("l_tax", F.col("l_tax") + F.when(F.col("l_orderkey") % 100 == 1, 0.01).otherwise(0.0))
    return au.compare_manifests(au.manifest(a), au.manifest(b))


@query("table_diff", """WITH a AS (SELECT * FROM orders), b AS (SELECT * REPLACE (CASE WHEN o_custkey % 50 = 3 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice) FROM orders WHERE o_orderkey % 97 <> 0),
l AS (SELECT * FROM a EXCEPT ALL SELECT * FROM b), r AS (SELECT * FROM b EXCEPT ALL SELECT * FROM a)
SELECT *, 'left' AS side, count(*) AS copies FROM l GROUP BY ALL UNION ALL SELECT *, 'right', count(*) FROM r GROUP BY ALL""")
def table_diff(spark, sf_dir):
    """All columns of the orders against a run with changed and missing rows."""
    a = table(spark, sf_dir, "orders")
    b = a.where("o_orderkey % 97 <> 0").withColumn("o_totalprice", F.when(F.col("o_custkey") % 50 == 3, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return au.table_diff(a, b)


@query("export_audit", """WITH e AS (SELECT 'doc_' || doc_id AS table_name, CASE WHEN doc_id < 30 THEN -1 ELSE n_chars END AS expected_rows, CASE WHEN lang = 'de' THEN sha256('x') ELSE upper(sha256(text)) END AS expected_sha256 FROM documents),
o AS (SELECT 'doc_' || doc_id AS table_name, sha256(text) AS observed_sha256 FROM documents WHERE source <> 'src3')
SELECT table_name, expected_rows, expected_sha256, observed_sha256, CASE WHEN expected_rows < 0 THEN 'invalid_manifest' WHEN observed_sha256 IS NULL THEN 'missing' WHEN lower(observed_sha256) = lower(expected_sha256) THEN 'verified' ELSE 'hash_mismatch' END AS status
FROM e LEFT JOIN o USING (table_name)""")
def export_audit(spark, sf_dir):
    """J44, V5, F22."""
    d = table(spark, sf_dir, "documents").withColumn("table_name", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")))
    e = d.select("table_name", F.when(F.col("doc_id") < 30, -1).otherwise(F.col("n_chars")).alias("expected_rows"),
                 F.when(F.col("lang") == "de", F.sha2(F.lit("x"), 256)).otherwise(F.upper(F.sha2("text", 256))).alias("expected_sha256"))
    o = d.where("source <> 'src3'").select("table_name", F.sha2("text", 256).alias("observed_sha256"), F.col("text").alias("head"))
    return au.export_audit(e, o)


LEDGER_CTE = """l0 AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq, o_orderkey, o_orderstatus, CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN 'tampered' ELSE o_orderstatus END AS now FROM orders),
l1 AS (SELECT *, sha256(to_json({'o_custkey': o_custkey, 'o_orderkey': o_orderkey, 'o_orderstatus': o_orderstatus})::VARCHAR) AS record_hash, sha256(to_json({'o_custkey': o_custkey, 'o_orderkey': o_orderkey, 'o_orderstatus': now})::VARCHAR) AS digest FROM l0)"""


@query("hash_chain", f"""WITH {LEDGER_CTE}, l2 AS (SELECT *, lag(record_hash) OVER (PARTITION BY o_custkey ORDER BY seq) AS prev FROM l1), l3 AS (SELECT *, CASE WHEN seq % 40 = 0 THEN 'lost' ELSE prev END AS previous_hash FROM l2)
SELECT o_custkey, seq, CASE WHEN previous_hash IS DISTINCT FROM prev THEN 'previous_hash' ELSE 'record_hash' END AS broken FROM l3 WHERE previous_hash IS DISTINCT FROM prev OR record_hash <> digest""")
def hash_chain(spark, sf_dir):
    """Per-customer order chains with altered rows and lost links."""
    o = table(spark, sf_dir, "orders")
    # A ledger is numbered when it is written; here the number follows the order keys, bucket by bucket.
    l = running_total(o.withColumn("one", F.lit(1).cast("bigint")), ["o_custkey"], ["o_orderkey"], "one", "seq", F.floor(F.col("o_orderkey") / 100_000))
    h = fn.canonical_digest({"o_custkey": F.col("o_custkey"), "o_orderkey": F.col("o_orderkey"), "o_orderstatus": F.col("o_orderstatus")})
    l = l.withColumn("record_hash", h)
    l = stage(l.select("o_custkey", "seq", "o_orderkey", "o_orderstatus", "o_orderpriority", "record_hash"), "ledger")
    l = l.join(l.select("o_custkey", (F.col("seq") + 1).alias("seq"), F.col("record_hash").alias("previous_hash")), ["o_custkey", "seq"], "left")
    l = l.withColumn("previous_hash", F.when(F.col("seq") % 40 == 0, "lost").otherwise(F.col("previous_hash")))
    now = F.when((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P"), "tampered").otherwise(F.col("o_orderstatus"))
    digest = fn.canonical_digest({"o_custkey": F.col("o_custkey"), "o_orderkey": F.col("o_orderkey"), "o_orderstatus": now})
    return au.chain_breaks(l, ["o_custkey"], "seq", digest)


def trials(spark, sf_dir):
    """Events as a trial ledger: user = experiment, hour of day = trial, type = row kind."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "click", "trial_start").when(F.col("event_type") == "view", "trial_result").when(F.col("event_type") == "signup", "freeze").when(
        F.col("event_type") == "purchase", "trial").otherwise("note")
    return e.select(F.col("user_id").alias("experiment_id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.hour(F.col("ts").cast("timestamp")).alias("trial_id"), F.lit(20).alias("max_trials"),
                    F.when(F.col("value") > 50, "failed").otherwise("evaluated").alias("outcome"), F.when(F.col("value") > 80, "x").alias("failure_reason"),
                    (F.col("value") > 150).cast("string").alias("config_hash"), F.when(F.col("value") > 300, "h2").otherwise("h1").alias("holdout_id"), "value")


TRIAL_CTE = """tl AS (SELECT user_id AS experiment_id, event_id AS seq, CASE event_type WHEN 'click' THEN 'trial_start' WHEN 'view' THEN 'trial_result' WHEN 'signup' THEN 'freeze' WHEN 'purchase' THEN 'trial' ELSE 'note' END AS kind, hour(ts) AS trial_id, value,
  CASE WHEN value > 50 THEN 'failed' ELSE 'evaluated' END AS outcome, CASE WHEN value > 80 THEN 'x' END AS failure_reason, (value > 150)::VARCHAR AS config_hash, CASE WHEN value > 300 THEN 'h2' ELSE 'h1' END AS holdout_id FROM events)"""


@query("trial_budget", f"""WITH {TRIAL_CTE}, p AS (SELECT experiment_id, trial_id, count(*) FILTER (kind IN ('trial', 'trial_start')) AS s, count(*) FILTER (kind = 'trial_result') AS d, count(*) FILTER (kind = 'trial_result' AND outcome = 'failed' AND failure_reason IS NULL) AS u
  FROM tl WHERE kind IN ('trial', 'trial_start', 'trial_result') GROUP BY ALL)
SELECT experiment_id, sum(s)::BIGINT AS attempts, 20::INT AS max_trials, count(*) FILTER (s > 1) AS duplicate_ids, count(*) FILTER (d > 1) AS repeated_outcomes, count(*) FILTER (d > 0 AND s = 0) AS not_started, sum(u)::BIGINT AS failures_without_reason, sum(s) > 20 AS over_budget FROM p GROUP BY 1""")
def trial_budget(spark, sf_dir):
    """V2."""
    return au.trial_budget(trials(spark, sf_dir))


@query("frozen_config", f"""WITH {TRIAL_CTE}, f AS (SELECT experiment_id, arg_min(config_hash, seq) AS h, min(seq) AS at0 FROM tl WHERE kind = 'freeze' GROUP BY 1)
SELECT experiment_id, seq, CASE WHEN h IS NULL OR at0 > seq THEN 'experiment_not_frozen' ELSE 'frozen_config_changed' END AS reason FROM tl LEFT JOIN f USING (experiment_id) WHERE h IS NULL OR at0 > seq OR config_hash <> h""")
def frozen_config(spark, sf_dir):
    """V3."""
    return au.frozen_config(trials(spark, sf_dir), "seq")


@query("holdout_access", f"""WITH {TRIAL_CTE}, k AS (SELECT * REPLACE (CASE WHEN value > 250 THEN 'holdout_access' ELSE kind END AS kind) FROM tl), a AS (SELECT min(seq) AS f, arg_min(holdout_id, seq) AS id FROM k WHERE kind = 'holdout_access')
SELECT experiment_id, seq, CASE WHEN kind = 'holdout_access' THEN 'holdout_already_accessed' ELSE 'holdout_changed_after_access' END AS reason FROM k, a WHERE seq > f AND (kind = 'holdout_access' OR (kind = 'freeze' AND holdout_id IS DISTINCT FROM id))""")
def holdout_access(spark, sf_dir):
    """V4, V7."""
    t = trials(spark, sf_dir)
    return au.holdout_access(t.withColumn("kind", F.when(F.col("value") > 250, "holdout_access").otherwise(F.col("kind"))), "seq")


@query("latest_decision", """WITH p AS (SELECT o_custkey AS owner, o_orderdate::DATE AS at_day, min(o_orderstatus) AS lo, max(o_orderstatus) AS hi FROM orders GROUP BY ALL), q AS (SELECT owner, max(at_day) AS decided_at, arg_max(lo, at_day) AS lo, arg_max(hi, at_day) AS hi FROM p GROUP BY 1)
SELECT owner, decided_at, CASE WHEN lo = hi THEN lo END AS decision, lo <> hi AS conflict FROM q""")
def latest_decision(spark, sf_dir):
    """W14."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.to_date("o_orderdate").alias("at_day"), "o_orderstatus")
    return au.latest_decision(o, "owner", "at_day", "o_orderstatus")


@query("required_members", """SELECT o_custkey, list_sort(list_filter(['F', 'O', 'P'], lambda x: NOT list_contains(list(o_orderstatus), x))) AS missing, 0::BIGINT AS unexpected FROM orders GROUP BY 1""")
def required_members(spark, sf_dir):
    """J16, J39, T9."""
    return au.missing_members(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus", ["F", "O", "P"])


@query("key_mismatch", """SELECT DISTINCT c_custkey AS k, 'left' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') UNION ALL SELECT DISTINCT o_custkey, 'right' FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def key_mismatch(spark, sf_dir):
    """J15."""
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k"))
    return au.key_mismatch(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), o, ["k"])


@query("single_match", """WITH n AS (SELECT doc_id, count(*) AS m FROM labels WHERE quality = 1 GROUP BY 1) SELECT doc_id, coalesce(m, 0) AS matches, CASE WHEN m IS NULL THEN 'missing' WHEN m > 1 THEN 'ambiguous' END AS reason FROM documents LEFT JOIN n USING (doc_id)""")
def single_match(spark, sf_dir):
    """J40."""
    return au.exactly_one(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").where("quality = 1"), ["doc_id"])


@query("positional_match", """WITH s AS (SELECT conv_id, turn, role, text AS n FROM conversations WHERE turn < 5), e AS (SELECT conv_id, turn, CASE WHEN turn = 2 THEN 'user' ELSE role END AS role, text AS n FROM conversations WHERE turn > 0)
SELECT coalesce(s.conv_id, e.conv_id) AS conv_id, coalesce(s.turn, e.turn) AS turn, CASE WHEN s.conv_id IS NULL THEN 'missing_saved' WHEN e.conv_id IS NULL THEN 'unexpected' WHEN s.role IS NOT DISTINCT FROM e.role AND s.n IS NOT DISTINCT FROM e.n THEN 'equal' ELSE 'different' END AS status
FROM s FULL JOIN e ON s.conv_id = e.conv_id AND s.turn = e.turn""")
def positional_match(spark, sf_dir):
    """J37."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("n"))
    return au.positional_match(c.where("turn < 5"), c.where("turn > 0").withColumn("role", F.when(F.col("turn") == 2, "user").otherwise(F.col("role"))), ["conv_id", "turn"], ["role", "n"])


@query("resume_inputs", """SELECT doc_id::VARCHAR AS document_id, sha256(text) AS source_sha256, sha256(doc_id || '|' || sha256(text) || '|v1') AS resume_key FROM documents WHERE lang <> 'en' OR source = 'src1'""")
def resume_inputs(spark, sf_dir):
    """English documents were completed, one source's outputs changed since."""
    d = table(spark, sf_dir, "documents")
    i = d.select(F.col("doc_id").cast("string").alias("document_id"), F.sha2("text", 256).alias("source_sha256"))
    done = d.where("lang = 'en'").select(F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.sha2("text", 256), F.lit("v1")), 256).alias("resume_key"), F.lit("completed").alias("status"), F.lit("a").alias("output_sha256"),
                                         F.when(F.col("source") == "src1", "b").otherwise("a").alias("observed_sha256"))
    return au.resume(i, done, "v1")


@query("snapshot_violations", """WITH l AS (SELECT l_orderkey::VARCHAR AS e, l_linenumber::VARCHAR AS b, CASE WHEN l_discount = 0 THEN 0 ELSE l_quantity END AS strike, l_tax AS spot FROM lineitem)
SELECT table_name, rule, count(*) AS n FROM (SELECT 'option_legs' AS table_name, 'positive_strike' AS rule FROM l WHERE strike <= 0 UNION ALL SELECT 'option_legs', 'positive_spot_pre' FROM l WHERE spot <= 0
 UNION ALL SELECT 'option_legs', 'duplicate' FROM l GROUP BY e, b HAVING count(*) > 1 UNION ALL SELECT 'option_legs', 'strike_order' FROM l GROUP BY e, b UNION ALL SELECT 'option_legs', 'atm_strike' FROM l GROUP BY e, b
 UNION ALL SELECT 'option_legs', 'one_spot' FROM l GROUP BY e, b HAVING min(spot) <> max(spot)
 UNION ALL SELECT 'option_bars', 'duplicate' FROM orders GROUP BY o_custkey, o_orderdate HAVING count(*) > 1) GROUP BY ALL""")
def snapshot_violations(spark, sf_dir):
    """Rule counts over line items as legs and orders as bars (every calendar day counts as a session here)."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("event_id"), F.col("l_linenumber").cast("string").alias("bucket"), F.lit("C_K").alias("leg_code"), F.col("l_partkey").cast("string").alias("contract_ticker"),
                                                F.when(F.col("l_discount") == 0, 0.0).otherwise(F.col("l_quantity")).alias("strike"), F.col("l_tax").alias("spot_pre"), F.lit(100).alias("shares_per_contract"), F.lit("x").alias("expiration_date"))
    b = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("contract_ticker"), F.to_date("o_orderdate").alias("session"), F.col("o_totalprice").alias("close"), F.lit(1.0).alias("volume"))
    s = spark.sql("SELECT explode(sequence(DATE'1994-01-01', DATE'2003-12-31')) AS session")
    return au.snapshot_violations(l, b, s).groupBy("table_name", "rule").agg(F.count("*").alias("n"))


FACTS = """f AS (SELECT l_orderkey AS k, CASE l_linenumber WHEN 1 THEN 'revenue' WHEN 2 THEN 'cost_of_revenue' WHEN 3 THEN 'gross_profit' WHEN 4 THEN 'assets' WHEN 5 THEN 'liabilities' WHEN 6 THEN 'equity' ELSE 'cash_end' END AS name, l_quantity AS value, l_shipdate::DATE AS filed_at FROM lineitem),
v AS (SELECT k, name, arg_max(value, (filed_at, value)) AS value FROM f WHERE filed_at <= DATE '1999-06-30' GROUP BY ALL),
g AS (SELECT k, max(value) FILTER (name = 'revenue') - max(value) FILTER (name = 'cost_of_revenue') AS gc, max(value) FILTER (name = 'gross_profit') AS gr, max(value) FILTER (name = 'liabilities') + max(value) FILTER (name = 'equity') AS bc, max(value) FILTER (name = 'assets') AS br, max(value) FILTER (name = 'cash_end') AS cr FROM v GROUP BY 1)"""


@query("reconciliation", f"""WITH {FACTS}, r AS (SELECT k, unnest(['gross_profit', 'balance', 'cash']) AS check_name, unnest([gr, br, cr]) AS reported, unnest([gc, bc, NULL]) AS computed FROM g)
SELECT k, check_name, reported, computed, reported - computed AS residual, CASE WHEN reported - computed IS NULL THEN 'not_disclosed' WHEN abs(reported - computed) <= 0.5 THEN 'reconciled' ELSE 'unresolved' END AS status FROM r""")
def reconciliation(spark, sf_dir):
    """V6: bridges as known on a date."""
    names = F.element_at(F.array(*[F.lit(x) for x in ("revenue", "cost_of_revenue", "gross_profit", "assets", "liabilities", "equity", "cash_end")]), F.least("l_linenumber", F.lit(7)))
    f = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), names.alias("name"), F.col("l_quantity").alias("value"), F.to_date("l_shipdate").alias("filed_at"))
    # one value per (key, name, date) before the newest is taken
    f = f.groupBy("k", "name", "filed_at").agg(F.max("value").alias("value"))
    return au.reconciliation(f, ["k"], as_of="1999-06-30")


@query("aware_stamps", r"""WITH s AS (SELECT event_id, CASE event_type WHEN 'click' THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 'view' THEN strftime(ts, '%Y-%m-%d %H:%M:%S+00:00') WHEN 'error' THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS raw, event_type, ts FROM events)
SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') END AS stamp FROM s""")
def aware_stamps(spark, sf_dir):
    """only clocks with a time and an offset survive."""
    t = F.col("ts").cast("timestamp")
    raw = (F.when(F.col("event_type") == "click", F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("event_type") == "view", F.concat(F.date_format(t, "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00")))
           .when(F.col("event_type") == "error", F.date_format(t, "yyyy-MM-dd")).otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")))
    return table(spark, sf_dir, "events").select("event_id", fn.utc_stamp(fn.aware_utc(raw)).alias("stamp"))


@query("manifest_gate", r"""WITH m AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'team:' || doc_id ELSE 'doc-' || doc_id END AS d, CASE WHEN source = 'src1' THEN '/abs/' || doc_id WHEN source = 'src2' THEN '../../../data/raw/team_sources/team/../x' ELSE '../../../data/raw/team_sources/team/' || doc_id || '.txt' END AS p,
  CASE WHEN source = 'src3' THEN 'https://example.org/a#b' ELSE 'https://example.org/' || doc_id END AS u, CASE WHEN source = 'src4' THEN 'REPLACE_ME' ELSE sha256(text) END AS h, source, lang FROM documents)
SELECT doc_id, list_filter([CASE WHEN lang <> 'en' THEN 'document_id' END, CASE WHEN source IN ('src1', 'src2') THEN 'source_path' END, CASE WHEN source = 'src3' THEN 'source_url' END, CASE WHEN source = 'src4' THEN 'source_sha256' END, CASE WHEN source = 'src4' THEN 'placeholder' END], lambda x: x IS NOT NULL) AS reasons FROM m""")
def manifest_gate(spark, sf_dir):
    """P10, F23, A32."""
    d = table(spark, sf_dir, "documents")
    key = F.col("doc_id").cast("string")
    base = F.lit("../../../data/raw/team_sources/team/")
    m = d.select("doc_id", F.when(F.col("lang") == "en", F.concat(F.lit("team:"), key)).otherwise(F.concat(F.lit("doc-"), key)).alias("document_id"),
                 F.when(F.col("source") == "src1", F.concat(F.lit("/abs/"), key)).when(F.col("source") == "src2", F.concat(base, F.lit("../x"))).otherwise(F.concat(base, key, F.lit(".txt"))).alias("source_path"),
                 F.when(F.col("source") == "src3", "https://example.org/a#b").otherwise(F.concat(F.lit("https://example.org/"), key)).alias("source_url"),
                 F.when(F.col("source") == "src4", "REPLACE_ME").otherwise(F.sha2("text", 256)).alias("source_sha256"))
    return m.select("doc_id", gates.manifest_row_reasons("team").alias("reasons"))
