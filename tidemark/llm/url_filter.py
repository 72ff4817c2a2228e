"""URL filter: host and path rules first, then logistic regression on hashed character n-grams of host and path.

The model is trained in numpy from the small labelled table below each time; it has 2^13 weights, so a broadcast of it is bounded.

Defined cases: a null url, or one without '://', has empty host and path; no rule fits it and the model judges the empty string; repeated rows
are judged one by one; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import query, table
from tidemark.llm.license_scan import LOWER, UPPER

BITS = 13
SIZES = (3, 4, 5)
#: (host, path start, verdict); the longest fitting rule wins.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))

# Labelled URLs (host, path).
BLOCKED = (
    ("casino-royal.test", "/slots"), ("win-casino.test", "/play/123"), ("best-casino-online.test", "/en/77"), ("casino-bonus.test", "/fr/9"), ("poker-stars-free.test", "/join"), ("free-poker.test", "/en/12"),
    ("free-bets.test", "/today"), ("bets-now.test", "/de/5"), ("sports-betting.test", "/odds"), ("betting-tips.test", "/en/301.html"), ("slots-jackpot.test", "/spin"), ("jackpot-city.test", "/"),
    ("adult-x.test", "/gallery/4"), ("adult-chat.test", "/en/88"), ("xxx-tube.test", "/video/99"), ("free-porn.test", "/watch"), ("porn-hub-free.test", "/a"), ("sex-cams.test", "/live"), ("hot-sex.test", "/en/1"), ("escort-girls.test", "/city"),
    ("spam-farm.test", "/en/750"), ("spam-links.test", "/buy"), ("link-farm.test", "/seo/1"), ("seo-spam.test", "/post/3"), ("cheap-pills.test", "/viagra"), ("buy-viagra.test", "/order"), ("viagra-online.test", "/en/5"), ("pills-shop.test", "/cialis"),
    ("payday-loans.test", "/apply"), ("quick-loans.test", "/cash-now"), ("cash-advance.test", "/win-money"), ("win-prize.test", "/claim"), ("free-iphone-win.test", "/claim/now"), ("crack-download.test", "/keygen"), ("warez-crack.test", "/serial"), ("malware-host.test", "/payload.exe"),
    ("phishing-login.test", "/verify/account"), ("account-verify.test", "/login/secure"), ("replica-watches.test", "/sale"), ("lucky-casino.test", "/bonus?x"), ("gambling-site.test", "/roulette"), ("roulette-win.test", "/en/40"),
)
ALLOWED = (
    ("news.test", "/2024/05/story"), ("www.library.test", "/books/12"), ("blog.travel.test", "/en/217"), ("m.weather.test", "/de/511"), ("university.test", "/courses/math"), ("museum.test", "/exhibits/3"),
    ("recipes.test", "/soup.html"), ("docs.python.test", "/tutorial/index.html"), ("www.garden.test", "/fr/748"), ("forum.bikes.test", "/thread/88"), ("history.test", "/en/685"), ("science.test", "/articles/2024"),
    ("school.test", "/teachers"), ("city-council.test", "/services"), ("hospital.test", "/departments/eye"), ("theatre.test", "/programme"), ("music.test", "/album/7"), ("blog.theran.test", "/en/214"),
    ("ththre.test", "/fr/825"), ("ontion.test", "/en/742/"), ("www.erthe.test", "/de/49"), ("inghan.test", "/es/883"), ("m.thering.test", "/en/625.html"), ("blog.onere.test", "/fr/371"),
    ("edshou.test", "/de/952"), ("lytion.test", "/es/797"), ("bleand.test", "/en/403.html"), ("www.shareti.test", "/en/99"), ("reando.test", "/de/252.html"), ("ntourt.test", "/fr/10"),
    ("wikipedia.test", "/wiki/Tree"), ("maps.test", "/route"), ("shop.books.test", "/cart"), ("photos.test", "/album/12"), ("research.test", "/paper/44.pdf"), ("government.test", "/law/7"),
    ("sports.test", "/football/results"), ("wine.test", "/regions"), ("windows.test", "/support"), ("better-homes.test", "/en/23"), ("alphabet.test", "/letters"), ("express.test", "/en/6"),
)


def features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of ^host$ and of ^path$ up to its digits: (row, slot) of each, as two arrays."""
    rows, slots = [], []
    for i, (host, path) in enumerate(zip(hosts, paths)):
        for kind, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
            grams = {text[j:j + n] for n in SIZES for j in range(len(text) - n + 1)}
            grams = {g for g in grams if not any(c.isdigit() for c in g)}
            rows += [i] * len(grams)
            slots += [zlib.crc32((kind + g).encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for g in grams]
    return np.array(rows, np.int64), np.array(slots, np.int64)


def margins(weights: np.ndarray, bias: float, rows: np.ndarray, slots: np.ndarray, n: int) -> np.ndarray:
    size = np.maximum(np.bincount(rows, minlength=n), 1)
    return bias + np.bincount(rows, weights[slots], minlength=n) / np.sqrt(size)


def train(steps: int = 400, rate: float = 1.0, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """Full-batch gradient descent on the labelled table. Its own top-level domain says nothing and is left out."""
    labelled = [(h, p, 1.0) for h, p in BLOCKED] + [(h, p, 0.0) for h, p in ALLOWED]
    hosts, paths = [h.removesuffix(".test") for h, _, _ in labelled], [p for _, p, _ in labelled]
    y, n = np.array([v for *_, v in labelled]), len(labelled)
    rows, slots = features(hosts, paths)
    scale = 1 / np.sqrt(np.maximum(np.bincount(rows, minlength=n), 1))
    weights, bias = np.zeros(1 << BITS), 0.0
    for _ in range(steps):
        off = 1 / (1 + np.exp(-margins(weights, bias, rows, slots, n))) - y
        weights -= rate * (np.bincount(slots, (off * scale)[rows], minlength=1 << BITS) / np.sqrt(n) + decay * weights)
        bias -= rate * off.mean()
    return weights, bias


def split_url(url) -> tuple[F.Column, F.Column]:
    """Host and path of a url, by position only: nothing is decoded or resolved."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"(?s)^([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per row of `pages`: page_id, host, path, rule, verdict, score (the model's probability of block)."""
    host, path = split_url(F.col("url"))
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit(p)) for h, p, _ in ordered]
    rule = F.coalesce(*[F.when(f, F.lit(h + p)) for f, (h, p, _) in zip(fits, ordered)])
    verdict = F.coalesce(*[F.when(f, F.lit(v)) for f, (_, _, v) in zip(fits, ordered)])
    weights, bias = train()

    @F.pandas_udf("double")
    def blocked(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        rows, slots = features(list(hosts), list(paths))
        return pd.Series(1 / (1 + np.exp(-margins(weights, bias, rows, slots, len(hosts)))))

    cut = pages.select("page_id", host.alias("host"), path.alias("path"))
    # the public suffix of a host carries no label
    scored = cut.withColumn("score", blocked(F.regexp_replace("host", r"\.[a-z]+$", ""), F.col("path")))
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")


@query("op6_url_filter")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"))
