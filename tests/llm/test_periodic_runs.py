"""Periodic runs against a search of every period at every place."""

import hashlib
import re
import zlib

import numpy as np

from tidemark.llm import periodic_runs
from tidemark.llm.common import QUERIES


def plain_runs(w):
    """(start, length, period): maximal stretches for each period, kept where no smaller period fits."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def plain(doc_id, text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    h = zlib.crc32(str(doc_id).encode() if doc_id is not None else b"")
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = None
    for s, n, q in runs:
        if best is None or n * best[2] > best[1] * q or (n * best[2] == best[1] * q and (s, q) < (best[0], best[2])):
            best = (s, n, q)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


NAMES = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def wrap(w):
    """A sequence with its own values before and behind."""
    return np.array([900, *w, 901]), 900


def test_extensions_of_the_grammar():
    rng = np.random.default_rng(3)
    for _ in range(60):
        w = rng.integers(0, int(rng.integers(1, 4)), int(rng.integers(2, 80))).tolist()
        w = (w * int(rng.integers(1, 5)))[:150]
        words, single = wrap(w)
        g = periodic_runs.Grammar(words, single)
        i, j = (x.ravel() for x in np.meshgrid(np.arange(1, len(words) - 1), np.arange(1, len(words) - 1)))
        i, j = i[i != j], j[i != j]
        for way in (1, -1):
            got = g.common(i, j, way)
            for x, y, k in zip(i.tolist(), j.tolist(), got.tolist()):
                n = 0
                while words[x + way * n] == words[y + way * n]:
                    n += 1
                assert k == n


def test_runs_of_random_and_periodic_sequences():
    rng = np.random.default_rng(5)
    for _ in range(300):
        w = rng.integers(0, int(rng.integers(1, 4)), int(rng.integers(1, 40))).tolist()
        w = w[:5] + w * int(rng.integers(1, 7)) + rng.integers(0, 2, int(rng.integers(0, 30))).tolist()
        words, single = wrap(w)
        got = [(s - 1, n, q) for s, n, q in periodic_runs.runs(words, single, len(w)).tolist()]
        assert got == plain_runs(w)


def test_query_over_odd_texts(spark, tmp_path):
    rng = np.random.default_rng(6)
    texts = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "a b " * 9, "x " + "b c " * 4 + "y", "é é " * 20, "the x the y the z the w the v " * 3]
    texts += [" ".join(rng.choice(list("abc"), int(rng.integers(1, 200)))) for _ in range(120)]
    texts += ["one " * 3000 + " ".join(str(i) for i in range(300)) * 2, " ".join(str(i % 37) for i in range(3000)), texts[9], texts[9]]
    rows = [(k if k % 50 else None, t, 1) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, words int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r[c] for c in NAMES) for r in QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((plain(k, t) for k, t, _ in rows), key=str)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["op12_periodic_runs"](spark, str(tmp_path)).count() == 0


def test_query_is_whole(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    docs = [r for r in docs if len(r.text or "") < 20_000]
    got = {r.doc_id: tuple(r[c] for c in NAMES) for r in QUERIES["op12_periodic_runs"](spark, "/root/testdata/sf0.001").collect()}
    assert all(got[r.doc_id] == plain(r.doc_id, r.text) for r in docs)
