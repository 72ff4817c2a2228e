"""Each pipeline stage against a plain version on a fixture with nulls, empty and long texts, reused ids, copies and clashing column names."""

import collections
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept int, id string"
STEP = dict(corpus_pipeline.STAGES)


def fixture():
    rng = np.random.default_rng(12)
    words = {lang: ["".join(rng.choice(list(letters), int(rng.integers(3, 9)))) for _ in range(150)] for lang, letters in (("aa", "abcde"), ("bb", "uvwxyz"))}
    make = lambda lang, n: " ".join(rng.choice(words[lang], n))
    texts = [(lang, make(lang, int(rng.integers(20, 90)))) for lang in ("aa", "bb") for _ in range(30)]
    near = texts[3][1].split()
    texts += [("aa", " ".join([*near[:5], "changed", *near[6:]])), ("aa", "  ".join(near)), texts[7], texts[7], ("aa", None), ("bb", ""), (None, "12 34 !!"), ("bb", make("bb", 6000)), (None, make("aa", 40))]
    rows = [(i, t, lang, f"s{i % 3}" if i % 7 else None, len(t or ""), i % 5, "x") for i, (lang, t) in enumerate(texts)]
    return rows + [(5, texts[9][1], "aa", "s1", 1, 0, "y"), (None, make("aa", 30), "aa", "s0", 1, 0, "z"), (None, texts[2][1], "aa", "s0", 1, 0, "z")]


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def squeeze(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.fixture(scope="module")
def outputs(spark):
    docs, out = spark.createDataFrame(fixture(), SCHEMA).repartition(3), {}
    for name, step in corpus_pipeline.STAGES:
        out[name] = (docs, rows_of(docs), step(spark, docs, "").cache())
        docs = out[name][2]
    return out


def test_language_rejects_only_texts_without_letters(outputs):
    docs, before, after = outputs["language_id"]
    assert after.columns == docs.columns
    assert sorted(rows_of(after), key=str) == sorted((r for r in before if re.search(r"[^\W\d_]", r[1] or "")), key=str)


def test_exact_dedup_keeps_one_of_each_text(outputs):
    _, before, after = outputs["exact_dedup"]
    groups = collections.defaultdict(list)
    for r in before:
        groups[squeeze(r[1])].append((r[0] is None, r[0] or 0, r))
    kept = rows_of(after)
    assert sorted(squeeze(r[1]) for r in kept) == sorted(groups) and {r[0] for r in kept} <= {g[2][0] for v in groups.values() for g in v}
    assert all((r[0] is None, r[0] or 0) == min(groups[squeeze(r[1])], key=lambda g: g[:2])[:2] for r in kept)


def test_jaccard_keeps_the_first_of_each_group(outputs):
    _, before, after = outputs["jaccard_join"]

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = [(r[0], shingles(r[1])) for r in before if r[0] is not None]
    root = {i: i for i, _ in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in sets:
        for b, y in sets:
            if a < b and x and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((top(a), top(b)))
                root[q] = p
    want = [r for r in before if r[0] is None or top(r[0]) == r[0]]
    assert sorted(rows_of(after), key=str) == sorted(want, key=str) and len(want) < len(before)


def test_mix_comes_near_its_targets(outputs):
    _, before, after = outputs["source_mix"]
    size = lambda r: len([w for w in re.split(r"[\x20\x09-\x0D]+", r[1] or "") if w])
    have, took = collections.Counter(), collections.Counter()
    for r in before:
        have[r[3]] += size(r)
    for r in rows_of(after):
        took[r[3]] += size(r)
    copies = collections.Counter(map(str, rows_of(after)))
    assert set(copies) <= set(map(str, before)) and max(copies.values()) <= 2
    order = sorted((s for s in have if s is not None), key=str) + [s for s in have if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    open_, left, target = set(order), 1.5 * sum(have.values()), {}
    while open_:
        full = {s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) >= 2 * have[s]}
        for s in full or open_:
            target[s] = 2 * have[s] if full else left * weight[s] / sum(weight[x] for x in open_)
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    longest = max(map(size, before))
    assert all(abs(took[s] - target[s]) <= longest for s in order)


def test_packing_holds_every_token_once(outputs):
    from tokenizers import Tokenizer

    from tidemark.llm.tokens import vocabulary
    _, before, after = outputs["packing"]
    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = collections.Counter()
    for r in before:
        ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        for s in range(0, len(ids), 4096):
            want[r[0], s, len(ids[s:s + 4096]), zlib.crc32(ids[s:s + 4096])] += 1
    got = after.collect()
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in got) == want
    room = collections.defaultdict(list)
    for r in got:
        room[r.sequence_id].append((r.offset, r.length))
    for pieces in room.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 4096


@pytest.mark.parametrize("name", list(STEP))
def test_stages_take_an_empty_table(spark, name):
    assert STEP[name](spark, spark.createDataFrame([], SCHEMA), "").count() == 0
