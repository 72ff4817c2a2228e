"""Suffix-array dedup against a plain scan of all 100-byte strings."""

import hashlib

import numpy as np
import pytest

from tidemark.llm import suffix_dedup
from tidemark.llm.common import QUERIES

SCHEMA = "doc_id long, text string, x string, blk int"


def plain(rows, width=100):
    """Removed bytes by looking up every string of `width` bytes; rows in order."""
    seen, out = {}, []
    for doc, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            w = b[i:i + width]
            if w in seen:
                gone[i:i + width] = True
            else:
                seen[w] = doc
        runs = int((gone & ~np.append(False, gone[:-1])).sum()) if len(b) else 0
        out.append((doc, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def ours(spark, rows, parts=3, **sizes):
    df = spark.createDataFrame([(i, t, "q", 7) for i, t in rows], SCHEMA).repartition(parts)
    got = suffix_dedup.dedup(df, **sizes).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got), key=str)


def corpus():
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdeé"), int(rng.integers(2, 8)))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words, n))
    passage, wide = prose(40), "日本語" * 50
    texts = [prose(int(rng.integers(1, 120))) for _ in range(40)]
    texts += [prose(20) + passage + prose(15) for _ in range(12)] + [passage, passage[:99], passage[:100], passage * 3]
    near = prose(150).split(" ")
    for k in range(10):
        near[k * 13] = "changed"
        texts.append(" ".join(near))
    texts += ["a" * 99, "a" * 100, "a" * 101, "a" * 700, "ab" * 300, "b" + "ab" * 60, wide, wide + "x", "y" + wide * 2, "", None, None]
    texts += [texts[3], texts[3], prose(9000), texts[40]]
    order = rng.permutation(len(texts))
    return [(int(k) - 5, texts[j]) for k, j in enumerate(order)]


def test_suffix_array_of_small_strings():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = rng.integers(1, int(rng.integers(2, 6)) + 1, int(rng.integers(1, 60)))
        assert suffix_dedup.suffix_array(a, int(a.max()) + 1).tolist() == sorted(range(len(a)), key=lambda i: a[i:].tolist())


def test_wide_names_fall_back_to_naming():
    a = np.array([3, 1, 3, 1, 3, 2, 3, 1], np.int64) << 40
    assert suffix_dedup.suffix_array(a, 1 << 50).tolist() == sorted(range(len(a)), key=lambda i: a[i:].tolist())


@pytest.mark.parametrize("hot, block, leaf", [(15_000, 1 << 22, 1 << 21), (2, 2000, 3000), (15_000, 3000, 500)])
def test_removed_bytes(spark, hot, block, leaf):
    """With ordinary sizes, with every repeated anchor frequent, and with small blocks and sorts."""
    rows = corpus()
    assert ours(spark, rows, block=block, hot=hot, leaf=leaf, group_bytes=4 * block, group_anchors=block) == plain(sorted(rows))


def test_null_ids_and_repeated_rows(spark):
    long = "some words of a text that is surely longer than one hundred bytes, since it goes on and on until it has them all"
    got = ours(spark, [(None, long), (5, long), (5, long), (5, None), (6, "")])
    assert [r[2] for r in got if r[0] == 5 and r[1]] in ([0, len(long)], [len(long), 0])
    assert [r[2] for r in got if r[0] is None] == [len(long)]
    assert len(got) == 5


def test_empty_table(spark):
    assert ours(spark, []) == []


def test_query_is_whole(spark):
    got = QUERIES["op11_suffix_dedup"](spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in got.collect()), key=str) == plain([(r.doc_id, r.text) for r in docs])
