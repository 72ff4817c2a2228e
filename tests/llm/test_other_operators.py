"""Embedding links, components, URL filter, range coder and the pipeline against plain versions."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import embedding_links, range_coder, url_filter
from tidemark.llm.components import components


def least_reachable(ids, links):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 200)]
    label = least_reachable({x for e in links for x in e}, links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "t").collect()}
    assert got == {k: v for k, v in label.items() if k != v}
    assert components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


@pytest.mark.parametrize("block", [2048, 16])
def test_embedding_links(spark, block):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(60, 24))
    vectors = [base[i % 60] + rng.normal(size=24) * rng.choice([0.05, 0.22, 0.3]) for i in range(150)] + [base[0]] * 5
    rows = [(i, [float(np.float32(x)) for x in v], 1) for i, v in enumerate(vectors)]
    rows += [(900, None, 1), (901, [0.0] * 24, 1), (902, [float("nan")] * 24, 1), (903, [None] + [1.0] * 23, 1), (904, [], 1), (905, [1.0, 2.0], 1), (906, [2.0, 4.0], 1), (907, [float("inf")] * 24, 1), (None, [1.0] * 24, 1)]
    ok = {i: np.array(v) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    pairs = [(a, b) for a in ok for b in ok if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / math.sqrt(ok[a] @ ok[a]) / math.sqrt(ok[b] @ ok[b]) >= 0.95]
    label = least_reachable(ok, pairs)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"links": F.lit(1), "node": F.lit(2)})
    got = embedding_links.near(df, block=block).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, False)
        else:
            assert (r.n_links, r.component_id, r.kept) == (sum(r.vec_id in p for p in pairs), label.get(r.vec_id, r.vec_id), label.get(r.vec_id, r.vec_id) == r.vec_id), r
    assert embedding_links.near(df.limit(0)).count() == 0


def test_quantisation_bound_holds():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(80, 33)), rng.standard_t(2, size=(70, 33))
    ua, qa, sa, ea = embedding_links.quantise(a)
    ub, qb, sb, eb = embedding_links.quantise(b)
    close = (qa.astype(float) @ qb.T.astype(float)) * sa[:, None] * sb
    bound = np.sqrt(((qa * sa[:, None]) ** 2).sum(1))[:, None] * eb + ea[:, None] * np.sqrt(((qb * sb[:, None]) ** 2).sum(1)) + ea[:, None] * eb
    assert (np.abs(ua @ ub.T - close) <= bound + 1e-12).all()


def test_range_coder_round_trips():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 255, 256, 257, 1000, 5000):
        for high in (1, 3, 1000, 50257, range_coder.IDS - 1):
            ids = rng.integers(0, high, n).astype(np.uint32)
            ids[n // 2:n // 2 + n // 4] = ids[:n // 4]
            assert (range_coder.decode(range_coder.encode(ids)) == ids).all()
    repeated = np.tile(rng.integers(0, 50000, 50).astype(np.uint32), 400)
    coded = range_coder.encode(repeated)
    assert len(coded) < len(repeated)
    caught = 0
    for at in range(40, len(coded), 37):
        damaged = bytearray(coded)
        damaged[at] ^= 4
        try:
            # the last bits of a block may say nothing; any other damage is found
            assert (range_coder.decode(bytes(damaged)) == repeated).all()
        except ValueError:
            caught += 1
    assert caught > 0.5 * len(range(40, len(coded), 37))
    with pytest.raises(ValueError):
        range_coder.encode(np.array([range_coder.IDS + 1], np.uint32))


def test_range_coder_learns_from_the_whole_sequence():
    """op1: ids that one other always follows cost next to nothing, and the models are stored once, not learnt anew in every block."""
    rng = np.random.default_rng(2)
    ids = np.stack([a := rng.integers(0, 30000, 40_000).astype(np.uint32), a + 30000], 1).ravel()
    coded = range_coder.encode(ids)
    assert (range_coder.decode(coded) == ids).all()
    assert len(range_coder.encode(np.tile(ids[:50], 2000))) < 8_000
    damaged = bytearray(coded)
    damaged[60] ^= 4  # in the models
    with pytest.raises(ValueError):
        range_coder.decode(bytes(damaged))


def test_url_filter(spark):
    urls = ["http://a.com/x", "http://A.Example.com/en/1?q#f", "https://www.example.com/en/", "https://m.www.example.com/en/9", "http://b.net/es/2", "http://net/fr/", "http://b.net/ES/2", "http://example.com", "http://notexample.com/en/1", None, "no scheme/en", "http://", "ftp://x.org#/en/", "http://q.org?://b.com/", "http://casino-win.org/play", "http://casino-win.org/play", "http://x.com:80/a"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("score", F.lit(1))
    got = sorted(url_filter.judge(df).collect())
    assert len(got) == len(urls)
    for r, url in zip(got, urls):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path, r.rule) == (host, path, max(fit)[1] if fit else None)
        assert r.verdict == (max(fit)[2] if fit else "block" if r.score >= 0.5 else "allow")
    assert got[14].verdict == "block"
    assert url_filter.judge(df.limit(0)).count() == 0


def test_url_model_fits_its_table():
    weights, bias = url_filter.train()
    for table, sign in ((url_filter.BLOCKED, 1), (url_filter.ALLOWED, -1)):
        hosts, paths = [h.removesuffix(".test") for h, _ in table], [p for _, p in table]
        margin = url_filter.margins(weights, bias, *url_filter.features(hosts, paths), len(hosts))
        assert (sign * margin > 0).mean() >= 0.95


def test_pipeline(spark):
    import corpus_pipeline
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, []
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, sf).cache()
        if name != "packing":
            assert out.columns == columns
            docs = out
        seen.append(out.count())
    assert seen[0] >= seen[1] >= seen[2] > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "jaccard_join", "source_mix", "packing"]


def test_slices_of_a_batch_hold_the_same_sets():
    """Slices are read as their own arrays: every kernel sees the same words as in one piece."""
    import pyarrow as pa

    from tidemark.llm.common import sliced
    from tidemark.llm.jaccard_join import shingle_sets
    texts = [f"word{k} " * (k % 7) + "and more of the same words again" for k in range(400)] + [None, "", "é " * 50]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    flat, sizes = shingle_sets(batch.column(1), 3)
    parts = [shingle_sets(b.column(1), 3) for b in sliced([batch.slice(3)], 700)]
    assert len(parts) > 5
    assert np.array_equal(np.concatenate([s for _, s in parts]), sizes[3:])
    assert np.array_equal(np.concatenate([f for f, _ in parts]), flat[int(sizes[:3].sum()):])
