"""Token alignment against the tokenizers themselves and a comparison of all byte ranges."""

import collections
import hashlib

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import token_alignment
from tidemark.llm.common import QUERIES
from tidemark.llm.tokens import vocabulary

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def tokens(text):
    """(ids, byte ranges) of both tokenizers; None where the bytes differ."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    if "t" not in _loaded:
        _loaded["t"], _loaded["s"] = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
        _loaded["t"].encode_special_tokens = True
    t, s = _loaded["t"], _loaded["s"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char = {chr(b): b for b in shown}
    char.update({chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)})
    out = []
    for ids, own in ((t.encode(" " + text, add_special_tokens=False).ids, lambda k: bytes(char[c] for c in t.id_to_token(k))),
                     (s.encode(text), lambda k: bytes([int(s.id_to_piece(k)[3:5], 16)]) if s.is_byte(k) else s.id_to_piece(k).replace("▁", " ").encode())):
        parts = [own(k) for k in ids]
        if b"".join(parts) != (" " + text).encode():
            return None
        ends = np.cumsum([len(p) for p in parts]).tolist()
        out.append((ids, list(zip([0, *ends], ends))))
    return out


_loaded = {}


def plain(rows):
    found, counts = [], collections.Counter()
    for doc, text in rows:
        both = tokens(text) if text else None
        if both is None:
            found.append((doc, 0, 0, 0, [], ""))
            continue
        (a, ra), (b, rb) = both
        links, j0 = [], 0
        for i, (s, e) in enumerate(ra):
            while rb[j0][1] <= s:
                j0 += 1
            j = j0
            while j < len(rb) and rb[j][0] < e:
                links.append((a[i], b[j]))
                j += 1
        cuts = sorted({e for _, e in ra} & {e for _, e in rb})
        lines, s = [], 0
        for e in cuts:
            lines.append("|".join(",".join(str(k) for k, (x, y) in zip(ids, own) if s <= x and y <= e) for ids, own in both))
            s = e
        counts.update(links)
        found.append((doc, len(a), len(b), len(cuts), links, hashlib.sha256(";".join(lines).encode()).hexdigest()))
    top = collections.Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return sorted(((d, na, nb, g, len(x), sum(counts[p] == top[p[1]] for p in x), sum(counts[p] for p in x), sha) for d, na, nb, g, x, sha in found), key=str)


def odd_texts():
    rng = np.random.default_rng(8)
    pool = ["the", "naïve", "日本語", "<|endoftext|>", "</s>", "<0x41>", "😀", "straße", "don't", "x" * 70, "12345", "é", "ế", "_", " ", "　", "퟿", "ﬁ"]
    texts = [None, "", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a \nb", "\n", "\t", "a▁b", "▁", "a\x00b", "<s> x", "﻿x y", "é e ́"]
    gaps = [" ", " ", " ", " ", "\n", "  ", "\t", " \n", ", "]
    for _ in range(150):
        n = int(rng.integers(1, 40))
        texts.append("".join(str(rng.choice(pool)) + str(rng.choice(gaps[:1] if rng.random() < 0.5 else gaps)) for _ in range(n)).strip(" " if rng.random() < 0.7 else ""))
    return texts


@pytest.mark.parametrize("work", [1, 2, 3, 7, 64])
def test_merge_path_gives_all_overlaps(work):
    rng = np.random.default_rng(work)
    for _ in range(150):
        n = int(rng.integers(1, 60))
        a, b = (np.append(np.sort(rng.choice(np.arange(1, n), min(n - 1, int(rng.integers(0, 30))), replace=False)), n).astype(np.int64) for _ in range(2))
        i, j, ends = token_alignment.merge_path(a, b, work)
        sa, sb = np.append(0, a[:-1]), np.append(0, b[:-1])
        assert list(zip(i.tolist(), j.tolist())) == [(x, y) for x in range(len(a)) for y in range(len(b)) if sa[x] < b[y] and sb[y] < a[x]]
        assert int(ends.sum()) == len(set(a.tolist()) & set(b.tolist()))


def test_words_give_the_tokens_of_whole_texts():
    texts = odd_texts()
    ids, counts = token_alignment.Both(A, B).encode(pa.array(texts))
    at = {"a": 0, "b": 0}
    for k, t in enumerate(texts):
        want = tokens(t) if t else None
        for side, own in zip("ab", want or (([],), ([],))):
            assert ids[side][at[side]:at[side] + counts[side][k]].tolist() == list(own[0]), (t, side)
            at[side] += counts[side][k]


@pytest.mark.parametrize("block, work", [(1 << 22, 64), (200, 3)])
def test_rows_and_counts(spark, block, work):
    texts = odd_texts()
    rows = [(k if k % 9 else None, t, k) for k, t in enumerate(texts)] + [(7, "the same text twice", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, pairs int").repartition(3)
    from tidemark.staging import stage
    got = token_alignment.counted(stage(token_alignment.aligned(docs, A, B, block, work), "test-blocks"))
    assert sorted((tuple(r[c] for c in NAMES) for r in got.collect()), key=str) == plain([r[:2] for r in rows])


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["op13_token_alignment"](spark, str(tmp_path)).count() == 0


def test_query_is_whole(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op13_token_alignment"](spark, "/root/testdata/sf0.001").collect()
    assert sorted((tuple(r[c] for c in NAMES) for r in got), key=str) == plain([tuple(r) for r in docs])
