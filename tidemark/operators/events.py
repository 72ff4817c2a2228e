"""Filing events: explode, collapse, align to sessions, placebo draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.scalars import ticker


def disclosures(raw: DataFrame, tag: str, start: str, end: str) -> DataFrame:
    """Tag and date range, both pushed to the scan."""
    return raw.where((F.col("tertiary_category") == tag) & F.col("filing_date").between(start, end))


def explode_tickers(raw: DataFrame) -> DataFrame:
    return raw.select("*", F.explode_outer("tickers").alias("_t")).withColumn("ticker", ticker(F.col("_t"))).drop("tickers", "_t")


def collapse(rows: DataFrame, universe: DataFrame, days: DataFrame) -> DataFrame:
    """One event per (cik, filing_date) with sessions around it.

    First non-null attributes follow (accession_number, ticker) order. The aggregation is partial, so a
    filer with many rows is reduced before the shuffle; the lag window then sees one row per day.
    """
    known = rows.join(universe.select("ticker").distinct(), "ticker", "left_semi")
    order = F.struct("accession_number", "ticker")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    ev = known.groupBy("cik", "filing_date").agg(*[first(c) for c in
                                                   ("ticker", "accession_number", "filing_url", "supporting_text")])
    ev = cal.align(ev, "filing_date", days, {"next_strict": "t_0", "prev_strict": "t_pre"})
    w = W.partitionBy("ticker").orderBy("filing_date", "cik")
    return ev.withColumn("days_since_prev_event",
                         F.datediff("filing_date", F.lag("filing_date").over(w)).cast("bigint"))


def hash_unit(*parts) -> F.Column:
    """Uniform [0, 1) draw from the first 8 hex digits of an md5; identical in any SQL engine."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def placebo(events: DataFrame, sessions: DataFrame, n: int, gap_days: int, seed: int) -> DataFrame:
    """`n` ordinary sessions more than `gap_days` away from every event of the same ticker: (draw, ticker, event_id, filing_date, reason).

    Draws are with replacement, and each is a row. A draw takes the event whose digest is next at or above its own number (the first one after
    the last), so tickers come up as often as they have events, and then a rank among the sessions that are admissible for the ticker. Those lie
    between neighbouring event days, less the gap on both sides: their counts, summed along the ticker's days, lead from the rank to the session
    without tries. Where no session is admissible `filing_date` is null and `reason` says so. Without events there are no rows.
    """
    unit = lambda what: hash_unit(F.lit(seed), F.lit(what), F.col("draw"))
    draws = events.sparkSession.range(n).withColumnRenamed("id", "draw").select("draw", unit("event").alias("u"), unit("session").alias("v"))
    own = events.where("ticker IS NOT NULL AND filing_date IS NOT NULL").select("ticker", "event_id", "filing_date")
    keyed = own.select(F.struct(hash_unit(F.lit(seed), F.lit("pick"), F.col("event_id")).alias("h"), "event_id", "ticker").alias("e"))
    cell = lambda c: F.floor(F.col(c) * n)
    cells = keyed.groupBy(cell("e.h").alias("cell")).agg(F.min("e").alias("e"))  # n rows at most, as all below that is not per ticker
    inside = (keyed.withColumn("cell", cell("e.h")).join(F.broadcast(draws.withColumn("cell", cell("u"))), "cell").where("e.h >= u")
              .groupBy("draw").agg(F.min("e").alias("near")))
    after = cells.select("cell", F.lit(None).cast("bigint").alias("draw"), "e").unionByName(draws.select(cell("u").alias("cell"), "draw", F.lit(None).cast(keyed.schema["e"].dataType).alias("e")))
    ahead = W.partitionBy(F.lit(0)).orderBy("cell").rangeBetween(1, W.unboundedFollowing)
    nxt = after.select("draw", F.first("e", ignorenulls=True).over(ahead).alias("next"), F.min("e").over(W.partitionBy(F.lit(0))).alias("first")).where("draw IS NOT NULL")
    picked = draws.join(nxt, "draw").join(inside, "draw", "left").select("draw", "v", F.coalesce("near", "next", "first").alias("e")).where("e IS NOT NULL").select("draw", "v", "e.ticker", "e.event_id")

    ranked = sessions.select(F.col("session").alias("day")).distinct()  # the calendar: a row per day; only its two ends come to the driver
    a, z = ranked.agg(F.date_sub(F.min("day"), 1), F.date_add(F.max("day"), 1)).first()
    upto = W.partitionBy(F.lit(0)).orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    days = (events.sparkSession.range(1).select(F.explode(F.sequence(F.lit(a), F.lit(z))).alias("day")).join(ranked.withColumn("open", F.lit(1)), "day", "left")
            .select("day", F.coalesce("open", F.lit(0)).alias("open"), F.sum(F.coalesce("open", F.lit(0))).over(upto).alias("upto")))
    counted = lambda day, name: days.select(F.col("day").alias(day), F.col("upto").alias(name))
    w = W.partitionBy("ticker").orderBy("d")
    seen = own.join(F.broadcast(picked.select("ticker").distinct()), "ticker", "left_semi").select("ticker", F.col("filing_date").alias("d")).distinct()
    lag, lead = F.lag("d").over(w), F.lead("d").over(w)
    gaps = seen.select("ticker", lag.alias("lo"), F.col("d").alias("hi"), lead.isNull().alias("last"))
    gaps = gaps.select("ticker", "lo", "hi").unionByName(gaps.where("last").select("ticker", F.col("hi").alias("lo"), F.lit(None).cast("date").alias("hi")))
    inner = lambda c: F.least(F.greatest(c, F.lit(a)), F.lit(z))
    gaps = gaps.select("ticker", inner(F.coalesce(F.date_add("lo", gap_days), F.lit(a))).alias("after"), inner(F.coalesce(F.date_sub("hi", gap_days + 1), F.lit(z))).alias("until"))
    gaps = gaps.join(F.broadcast(counted("after", "n_after")), "after").join(F.broadcast(counted("until", "n_until")), "until").where("n_until > n_after")
    along = W.partitionBy("ticker").orderBy("n_after")
    gaps = gaps.select("ticker", "n_after", (F.col("n_until") - F.col("n_after")).alias("size"))
    gaps = gaps.select("ticker", "n_after", "size", (F.sum("size").over(along) - F.col("size")).alias("skipped"), F.sum("size").over(W.partitionBy("ticker")).alias("free"))
    k = F.floor(F.col("v") * F.col("free"))
    hit = picked.join(gaps, "ticker").where((k >= F.col("skipped")) & (k < F.col("skipped") + F.col("size"))).select("draw", (F.col("n_after") + k - F.col("skipped") + 1).alias("upto"))
    found = hit.join(F.broadcast(days.where("open = 1").select("upto", F.col("day").alias("filing_date"))), "upto").select("draw", "filing_date")
    return picked.join(found, "draw", "left").select("draw", "ticker", "event_id", "filing_date", F.when(F.col("filing_date").isNull(), "no_admissible_session").alias("reason"))
