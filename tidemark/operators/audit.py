"""Manifests, table comparison, hash chains and trial ledgers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F, types as T

from ..functions import scalars as fn


#: Powers of ten that a double holds exactly.
_TENS = tuple(10.0 ** k for k in range(23))


def _two_product(a: Column, b: Column) -> tuple[Column, Column]:
    """a * b as a rounded product and its exact error (Dekker)."""
    def split(x):
        c = x * 134217729.0
        high = c - (c - x)
        return high, x - high
    (ah, al), (bh, bl), p = split(a), split(b), a * b
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def scientific(x: Column, digits: int) -> Column:
    """x as %.<digits>e in C: the binary value itself rounded, a tie to even.

    Java's formatter rounds the shortest decimal half up, which is another number only at a tie or next to one. Where x, scaled to an integer of
    digits + 1 places, may be so near one half, `_exact` decides. It stands in a lambda, to be evaluated for those alone.
    """
    return F.when(_near_tie(x, digits), F.get(F.transform(F.array(x), lambda v: _exact(v, digits)), F.lit(0))).otherwise(F.format_string(f"%.{digits}e", x))


def _near_tie(x: Column, digits: int) -> Column:
    a = F.abs(x)
    y = a * F.pow(F.lit(10.0), F.lit(digits) - F.floor(F.log10(a)))
    return F.coalesce(F.abs(y - F.floor(y) - 0.5) < 0.02, F.lit(False))


def _exact(x: Column, digits: int) -> Column:
    """`scientific` where the fraction of the scaled number is near one half: the exact product decides. Numbers that no exact power of ten scales
    (below 10^(digits - 22), from 10^(digits + 23)) and those whose scaled value leaves the range are left to the formatter."""
    tens = F.array(*[F.lit(t) for t in _TENS])
    a = F.abs(x)
    p = F.lit(digits) - F.floor(F.log10(a)).cast("int")
    ten = F.get(tens, F.abs(p))
    y = F.when(p >= 0, a * ten).otherwise(a / ten)
    low = F.floor(y).cast("double")
    tie = low + 0.5
    up, up_error = _two_product(a, ten)
    down, down_error = _two_product(tie, ten)
    over = F.when(p >= 0, (up - tie) + up_error).otherwise((a - down) - down_error)
    near = F.when((over > 0) | ((over == 0) & (low % 2 == 1)), low + 1).otherwise(low)
    n = F.when(F.abs(y - tie) < 0.01, near).otherwise(F.rint(y))
    s, e = n.cast("bigint").cast("string"), F.lit(digits) - p
    own = F.concat(F.when(x < 0, "-").otherwise(""), F.substring(s, 1, 1), F.lit("."), F.substring(s, 2, digits), F.when(e < 0, "e-").otherwise("e+"), F.lpad(F.abs(e).cast("string"), 2, "0"))
    fits = (a > 0) & (F.abs(p) <= 22) & (y >= 10.0 ** digits) & (y < 10.0 ** (digits + 1) - 1)
    return F.when(fits, own).otherwise(F.format_string(f"%.{digits}e", x))


def encoded(value: Column, kind: T.DataType) -> Column:
    """Any value as text that tells types, nulls and borders apart, the same in every engine: N null, S<bytes>:<text>, I integer, Q decimal,
    F double with 13 and float with 9 significant digits (minus zero is zero, FNaN, FInfinity), B boolean, D day number, T microseconds, X hex bytes,
    A<size>: elements, M<size>: entries by key, R fields in order."""
    sized = lambda parts, head: F.concat(F.lit(head), F.size(parts).cast("string"), F.lit(":"), F.array_join(parts, ""))
    if isinstance(kind, T.ArrayType):
        out = sized(F.transform(value, lambda x: encoded(x, kind.elementType)), "A")
    elif isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.concat(encoded(e["key"], kind.keyType), encoded(e["value"], kind.valueType)))
        out = sized(F.array_sort(entries), "M")
    elif isinstance(kind, T.StructType):
        out = F.concat(F.lit("R"), *[encoded(value[f.name], f.dataType) for f in kind.fields])
    elif isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        out = F.concat(F.lit("S"), F.octet_length(value).cast("string"), F.lit(":"), value)
    elif isinstance(kind, T.BinaryType):
        out = F.concat(F.lit("X"), F.octet_length(value).cast("string"), F.lit(":"), F.hex(value))
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        x = value.cast("double")
        out = F.concat(F.lit("F"), F.when(F.isnan(x), "NaN").when(F.abs(x) == float("inf"), F.when(x > 0, "Infinity").otherwise("-Infinity")).otherwise(scientific(x + F.lit(0.0), 8 if isinstance(kind, T.FloatType) else 12)), F.lit(";"))
    elif isinstance(kind, T.BooleanType):
        out = F.concat(F.lit("B"), F.when(value, "1").otherwise("0"))
    elif isinstance(kind, T.DateType):
        out = F.concat(F.lit("D"), F.unix_date(value).cast("string"), F.lit(";"))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        out = F.concat(F.lit("T"), F.unix_micros(value.cast("timestamp")).cast("string"), F.lit(";"))
    elif isinstance(kind, T.DecimalType):
        out = F.concat(F.lit("Q"), value.cast("string"), F.lit(";"))
    elif isinstance(kind, T.IntegralType):
        out = F.concat(F.lit("I"), value.cast("string"), F.lit(";"))
    else:
        raise TypeError(f"no encoding for {kind.simpleString()}")
    return F.when(value.isNull(), F.lit("N")).otherwise(out)


def row_digest(df: DataFrame) -> Column:
    """SHA-256 over the encoded row, all columns by name."""
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    return F.sha2(F.concat(*[F.concat(F.lit(f"{len(f.name)}:{f.name}="), encoded(F.col(f"`{f.name}`"), f.dataType)) for f in fields]), 256)


def content_hash(df: DataFrame, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """V1, K1: rows and an order-free content hash.

    Each row digest contributes eight 32-bit words and every word is summed exactly, so partial sums merge in any
    order; swapping, adding or dropping rows changes the sums.
    """
    h = df.select(*keys, row_digest(df).alias("_h"))
    words = [F.sum(F.conv(F.substring("_h", 1 + 8 * i, 8), 16, 10).cast("bigint")) for i in range(8)]
    sums = F.sha2(F.concat_ws("|", F.count("*").cast("string"), *[F.coalesce(w, F.lit(0)).cast("string") for w in words]), 256)
    g = h.groupBy(*keys) if keys else h
    return g.agg(F.lit(name).alias("table_name"), F.count("*").alias("rows"), sums.alias("sha256"))


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [content_hash(df, n) for n, df in tables.items()])


def compare_manifests(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per table whether two runs agree; a table missing on one side never does."""
    x = a.select("table_name", F.col("rows").alias("rows_a"), F.col("sha256").alias("_ha"))
    y = b.select("table_name", F.col("rows").alias("rows_b"), F.col("sha256").alias("_hb"))
    j = x.join(y, "table_name", "full_outer")
    return j.select("table_name", "rows_a", "rows_b", F.coalesce(F.col("_ha") == F.col("_hb"), F.lit(False)).alias("identical"))


def table_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (with multiplicity) present on one side only, from one shuffle on the whole row."""
    t = a.withColumn("_d", F.lit(1)).unionByName(b.withColumn("_d", F.lit(-1)))
    g = t.groupBy(*a.columns).agg(F.sum("_d").alias("_n")).where("_n <> 0")
    return g.select(*a.columns, F.when(F.col("_n") > 0, "left").otherwise("right").alias("side"), F.abs("_n").alias("copies"))


def export_audit(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Status of every sealed table. `observed` has table_name, observed_sha256, head (first characters)."""
    j = expected.join(observed, "table_name", "left")
    name_ok = F.col("table_name").rlike(r"^[A-Za-z0-9][A-Za-z0-9_-]*$")
    valid = name_ok & F.coalesce(F.col("expected_rows") >= 0, F.lit(False)) & F.coalesce(F.col("expected_sha256").rlike("^[0-9a-fA-F]{64}$"), F.lit(False))
    status = (F.when(~valid, "invalid_manifest").when(F.col("observed_sha256").isNull(), "missing")
              .when(F.coalesce(F.col("head").startswith("version https://git-lfs.github.com/spec/v1"), F.lit(False)), "lfs_pointer")
              .when(F.lower("observed_sha256") == F.lower("expected_sha256"), "verified").otherwise("hash_mismatch"))
    return j.withColumn("status", status).drop("head")


def chain_breaks(ledger: DataFrame, keys: Sequence[str], seq: str, payload: Column) -> DataFrame:
    """Rows whose link or digest is broken.

    The previous hash comes from an equi-join on the preceding sequence number, so a long ledger is not ordered
    inside one task.
    """
    l = ledger.withColumn("_digest", payload)
    prev = l.select(*keys, (F.col(seq) + 1).alias(seq), F.col("record_hash").alias("_prev"))
    j = l.join(prev, [*keys, seq], "left")
    link, body = F.col("previous_hash").eqNullSafe(F.col("_prev")), F.col("record_hash").eqNullSafe(F.col("_digest"))
    return j.where(~(link & body)).select(*keys, seq, F.when(~link, "previous_hash").otherwise("record_hash").alias("broken"))


def trial_budget(ledger: DataFrame) -> DataFrame:
    """V2: attempts against the budget, duplicate attempts and repeated terminal outcomes per experiment."""
    start, done = F.col("kind").isin("trial", "trial_start"), F.col("kind") == "trial_result"
    per = ledger.where("kind IN ('trial', 'trial_start', 'trial_result')").groupBy("experiment_id", "trial_id").agg(
        F.count_if(start).alias("s"), F.count_if(done).alias("d"), F.max("max_trials").alias("max_trials"),
        F.count_if(done & (F.col("outcome") == "failed") & F.col("failure_reason").isNull()).alias("u"))
    return per.groupBy("experiment_id").agg(F.sum("s").alias("attempts"), F.max("max_trials").alias("max_trials"), F.count_if(F.col("s") > 1).alias("duplicate_ids"),
                                            F.count_if(F.col("d") > 1).alias("repeated_outcomes"), F.count_if((F.col("d") > 0) & (F.col("s") == 0)).alias("not_started"),
                                            F.sum("u").alias("failures_without_reason")).withColumn("over_budget", F.col("attempts") > F.col("max_trials"))


def frozen_config(ledger: DataFrame, seq: str) -> DataFrame:
    """V3: rows whose configuration differs from the experiment's first frozen one."""
    first = ledger.where("kind = 'freeze'").groupBy("experiment_id").agg(F.min_by("config_hash", seq).alias("frozen_hash"), F.min(seq).alias("_at"))
    j = ledger.join(first, "experiment_id", "left")
    reason = F.when(F.col("frozen_hash").isNull() | (F.col("_at") > F.col(seq)), "experiment_not_frozen").when(F.col("config_hash") != F.col("frozen_hash"), "frozen_config_changed")
    return j.withColumn("reason", reason).where("reason IS NOT NULL").select("experiment_id", seq, "reason")


def holdout_access(ledger: DataFrame, seq: str) -> DataFrame:
    """V4, V7: more than one access, or a freeze naming another holdout after an access."""
    acc = ledger.where("kind = 'holdout_access'").agg(F.min(seq).alias("_first"), F.min_by("holdout_id", seq).alias("_id"), F.count("*").alias("accesses"))
    first = acc.select(F.struct("_first", "_id").alias("a")).scalar()
    j = ledger.withColumn("_a", first).select("*", "_a.*")
    again = (F.col("kind") == "holdout_access") & (F.col(seq) > F.col("_first"))
    moved = (F.col("kind") == "freeze") & (F.col(seq) > F.col("_first")) & ~F.col("holdout_id").eqNullSafe(F.col("_id"))
    return j.where(again | moved).select("experiment_id", seq, F.when(again, "holdout_already_accessed").otherwise("holdout_changed_after_access").alias("reason"))


def latest_decision(rows: DataFrame, owner: str, at: str, decision: str) -> DataFrame:
    """Latest decision per owner; a tie between different decisions is a conflict.

    Aggregated in two steps: (owner, time) first, so only distinct decisions of the winning instant are compared.
    """
    per = rows.groupBy(owner, at).agg(F.min(decision).alias("lo"), F.max(decision).alias("hi"))
    return per.groupBy(owner).agg(F.max(at).alias("decided_at"), F.max_by(F.struct("lo", "hi"), at).alias("d")).select(
        owner, "decided_at", F.when(F.col("d.lo") == F.col("d.hi"), F.col("d.lo")).alias("decision"), (F.col("d.lo") != F.col("d.hi")).alias("conflict"))


def missing_members(rows: DataFrame, keys: Sequence[str], member: str, required: Sequence[str]) -> DataFrame:
    """Required members a group lacks; only required values are collected, so the set is bounded."""
    g = rows.groupBy(*keys).agg(F.collect_set(F.when(F.col(member).isin(*required), F.col(member))).alias("_s"), F.count_if(~F.coalesce(F.col(member).isin(*required), F.lit(False))).alias("unexpected"))
    return g.select(*keys, F.array_sort(F.array_except(F.array(*map(F.lit, required)), "_s")).alias("missing"), "unexpected")


def key_mismatch(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys present on one side only."""
    left, right = a.select(*keys).distinct(), b.select(*keys).distinct()
    return left.join(right, list(keys), "left_anti").withColumn("side", F.lit("left")).unionByName(right.join(left, list(keys), "left_anti").withColumn("side", F.lit("right")))


def exactly_one(rows: DataFrame, lookup: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many lookup rows a key matches; anything but one is a reason."""
    n = lookup.groupBy(*keys).agg(F.count("*").alias("matches"))
    j = rows.join(n, list(keys), "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    return j.withColumn("reason", F.when(F.col("matches") == 0, "missing").when(F.col("matches") > 1, "ambiguous"))


def positional_match(saved: DataFrame, expected: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Saved and expected rows compared null-safely by position."""
    s = saved.select(*keys, F.struct(*cols).alias("_s"))
    e = expected.select(*keys, F.struct(*cols).alias("_e"))
    j = s.join(e, list(keys), "full_outer")
    status = F.when(F.col("_s").isNull(), "missing_saved").when(F.col("_e").isNull(), "unexpected").when(F.col("_s").eqNullSafe(F.col("_e")), "equal").otherwise("different")
    return j.select(*keys, status.alias("status"))


def resume(inputs: DataFrame, done: DataFrame, config: str) -> DataFrame:
    """Inputs whose (id, hash, configuration) key has no completed output with an unchanged hash."""
    keyed = inputs.withColumn("resume_key", F.sha2(F.concat_ws("|", "document_id", "source_sha256", F.lit(config)), 256))
    ok = done.where("status = 'completed' AND output_sha256 = observed_sha256").select("resume_key").distinct()
    return keyed.join(ok, "resume_key", "left_anti")


def snapshot_violations(legs: DataFrame, bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """(table_name, key, rule) for every broken integrity rule of a leg/bar snapshot."""
    num = lambda c, zero: ~fn.finite(F.col(c)) | (F.col(c) < 0 if zero else F.col(c) <= 0)
    def bad(df, table, key, cond, rule):
        return df.where(F.coalesce(cond, F.lit(True))).select(F.lit(table).alias("table_name"), key.alias("key"), F.lit(rule).alias("rule"))
    lk = F.concat_ws("/", "event_id", "bucket", "leg_code")
    bk = F.concat_ws("/", "contract_ticker", F.col("session").cast("string"))
    out = [bad(legs, "option_legs", lk, num(c, False), f"positive_{c}") for c in ("strike", "spot_pre")]
    out += [bad(legs, "option_legs", lk, F.col("shares_per_contract") != 100, "multiplier"), bad(legs, "option_legs", lk, F.col("contract_ticker").isNull(), "identity")]
    out += [bad(bars, "option_bars", bk, num(c, True), f"nonnegative_{c}") for c in ("close", "volume")]
    dup = lambda df, k: df.groupBy(*k).agg(F.count("*").alias("n")).where("n > 1")
    out.append(bad(dup(legs, ["event_id", "bucket", "leg_code"]), "option_legs", lk, F.lit(True), "duplicate"))
    out.append(bad(dup(bars, ["contract_ticker", "session"]), "option_bars", bk, F.lit(True), "duplicate"))
    out.append(bad(bars.join(F.broadcast(sessions.select("session")), "session", "left_anti"), "option_bars", bk, F.lit(True), "non_calendar_session"))
    g = legs.groupBy("event_id", "bucket")
    at = lambda code: F.max(F.when(F.col("leg_code") == code, F.col("strike")))
    per = g.agg(at("C_K").alias("k"), at("P_K").alias("k2"), F.max(F.when(F.col("leg_code").startswith("C_U"), F.col("strike"))).alias("u"),
                F.min(F.when(F.col("leg_code").startswith("P_L"), F.col("strike"))).alias("l"), (F.min("expiration_date") != F.max("expiration_date")).alias("e"), (F.min("spot_pre") != F.max("spot_pre")).alias("s"))
    gk = F.concat_ws("/", "event_id", "bucket")
    out += [bad(per, "option_legs", gk, ~((F.col("l") < F.col("k")) & (F.col("k") < F.col("u"))), "strike_order"), bad(per, "option_legs", gk, F.col("k") != F.col("k2"), "atm_strike"),
            bad(per, "option_legs", gk, F.col("e"), "one_expiry"), bad(per, "option_legs", gk, F.col("s"), "one_spot")]
    return reduce(lambda a, b: a.unionByName(b), out)


def reconciliation(facts: DataFrame, keys: Sequence[str], as_of: str | None = None) -> DataFrame:
    """V6: statement bridges from facts (name, value, filed_at), as known on a date or latest restated.

    Facts are first reduced to the newest value per name; each bridge then is a conditional aggregate.
    """
    known = facts.where(F.col("filed_at") <= F.lit(as_of).cast("date")) if as_of else facts
    v = known.groupBy(*keys, "name").agg(F.max_by("value", "filed_at").alias("value"))
    x = lambda n: F.max(F.when(F.col("name") == n, F.col("value")))
    g = v.groupBy(*keys).agg((x("revenue") - x("cost_of_revenue")).alias("gross_profit_calc"), x("gross_profit").alias("gross_profit_reported"),
                             (x("liabilities") + x("equity")).alias("balance_calc"), x("assets").alias("balance_reported"),
                             (x("cash_begin") + x("cfo") + x("cfi") + x("cff")).alias("cash_calc"), x("cash_end").alias("cash_reported"))
    names = ("gross_profit", "balance", "cash")
    r = g.select(*keys, F.inline(F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(f"{n}_reported").alias("reported"), F.col(f"{n}_calc").alias("computed")) for n in names])))
    diff = F.col("reported") - F.col("computed")
    return r.withColumn("residual", diff).withColumn("status", F.when(diff.isNull(), "not_disclosed").when(F.abs(diff) <= 0.5, "reconciled").otherwise("unresolved"))
