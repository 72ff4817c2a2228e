"""Reference SQL of the bootstrap of means."""

from __future__ import annotations

from ..operators import resample as rs


def means_cte(x: str, src: str, key: str, rid: str, value: str, seed: int) -> str:
    """Reference SQL of the replicate means: {x}r (key, rep, mean)."""
    number = "('0x' || substr(md5({t}), 1, 8))::BIGINT % " + str(rs.PRIME)
    weight = " + ".join(f"(u >= {p})::INT" for p in rs.POISSON)
    return f"""
{x}n AS (SELECT rep, {", ".join(number.format(t=f"'{seed}|' || rep::VARCHAR || '|{c}'") + f" AS {c}_" for c in "abc")} FROM range(2000) t(rep)),
{x}h AS (SELECT {key}, {value} AS v, {number.format(t=f"'{seed}|' || {rid}")} AS h FROM {src} WHERE {value} IS NOT NULL),
{x}u AS (SELECT {key}, rep, v, (x * ((x + c_) % {rs.PRIME}) % {rs.PRIME}) // 32768 AS u FROM (SELECT {key}, rep, v, c_, (a_ * h + b_) % {rs.PRIME} AS x FROM {x}h, {x}n)),
{x}r AS (SELECT {key}, rep, sum(w * v) / nullif(sum(w), 0) AS mean FROM (SELECT {key}, rep, v, {weight} AS w FROM {x}u) GROUP BY ALL)"""


def ci_cte(x: str, src: str, key: str, rid: str, value: str, seed: int = 0) -> str:
    """{x}ci (key, ci_lo, ci_hi): NULL below five values."""
    return f"""{means_cte(x, src, key, rid, value, seed)},
{x}c AS (SELECT {key}, count({value}) AS n_ci FROM {src} GROUP BY ALL),
{x}ci AS (SELECT {key}, CASE WHEN any_value(n_ci) >= 5 THEN quantile_cont(mean, 0.025) END AS ci_lo, CASE WHEN any_value(n_ci) >= 5 THEN quantile_cont(mean, 0.975) END AS ci_hi
  FROM {x}r JOIN {x}c USING ({key}) GROUP BY {key})"""
