"""Small-table tests of the text operators: each against a plain Python version, with nulls, empty and long texts, repeats, clashing columns, empty tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, jaccard_join, language_id, license_rules, license_scan, packing, source_mix, suffix_tree, token_files, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def corpus():
    rng = np.random.default_rng(3)
    made = {"en": "the and of thing ion er was that with on", "fr": "le la que éau oui ment dans pour est une", "de": "der und ungen keit schön über mit auf ein nicht"}
    rows = []
    for i in range(120):
        lang = ("en", "fr", "de")[i % 3]
        stock = made[lang].split()
        n = int(rng.integers(1, 120))
        text = " ".join("".join(rng.choice(stock, int(rng.integers(1, 3)))) for _ in range(n))
        rows.append((i, text, lang, f"s{i % 4}", len(text)))
    base = rows[5][1] + " alpha beta gamma delta " * 10
    rows += [(200, base, "en", "s0", 1), (201, base + " omega", "en", "s0", 1), (202, base.upper(), "en", "s1", 1), (203, base.replace(" ", "\n", 3), "en", None, 1)]
    rows += [(300, None, None, None, None), (301, "", "en", "s0", 0), (302, "   \t", "en", "s0", 4), (303, "12 34 !!", "en", "s1", 8), (304, "Word", "en", "s1", 4), (305, "Word", "en", "s1", 4), (305, "Word", "en", "s1", 4), (None, "no id here", "en", "s2", 10)]
    rows += [(400, "Long " + "tail words repeat " * 6000, "en", "s9", 9), (401, "Released under the MIT License. Under the Apache License, Version 2.0. CC BY-NC 4.0 &amp; under the MIT license", "en", "s9", 9)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({"n": F.lit(1), "digest": F.lit("x"), "label": F.lit(2), "score": F.lit(3), "row": F.lit(4), "size": F.lit(5), "id": F.lit(6), "part": F.lit(7)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, rows, empty):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[norm(t)].append(i)
    expected = sorted((str(i), str(min((x for x in groups[norm(t)] if x is not None), default=None)), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t, *_ in rows)
    got = exact_dedup.refine(docs, digest_all=True).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.digest) for r in got) == expected
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    lazy = {r.doc_id: r for r in exact_dedup.refine(docs).collect()}
    assert lazy[0].digest is None and lazy[304].digest and lazy[304].group_size == 3
    kept = exact_dedup.stage_exact_dedup(docs.sparkSession, docs, "")
    assert kept.columns == docs.columns
    assert sorted(norm(r.text) for r in kept.collect()) == sorted(groups)
    assert exact_dedup.refine(empty).count() == 0


def test_source_mix(docs, rows, empty):
    size = lambda t: len(WORD.findall(t or ""))
    total, weight = collections.Counter(), {}
    for _, t, _, s, _ in rows:
        total[s] += size(t)
    for k, s in enumerate(sorted(total, key=lambda s: (s is None, s or ""))):
        weight[s] = (5, 2, 1)[k % 3]
    target, free, left = {}, set(total), 1.5 * sum(total.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= 2 * total[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * total[s]
        left -= sum(2 * total[s] for s in over)
        free -= over
    target |= share
    got = source_mix.mix(docs).collect()
    assert len(got) == len(rows)
    taken = collections.Counter()
    for r in got:
        assert r.source_size == total[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
    for s in total:
        assert abs(taken[s] - target[s]) <= 2 * max(size(t) for _, t, _, x, _ in rows if x == s) + 1e-9
    again = source_mix.mix(docs.repartition(5)).collect()
    assert sorted((str(r.doc_id), r.size, r.copies) for r in got) == sorted((str(r.doc_id), r.size, r.copies) for r in again)
    mixed = source_mix.stage_mix(docs.sparkSession, docs, "")
    assert mixed.columns == docs.columns
    assert collections.Counter(r.doc_id for r in mixed.collect()) == collections.Counter({k: v for k, v in sum((collections.Counter({r.doc_id: r.copies}) for r in got), collections.Counter()).items() if v})
    assert source_mix.mix(empty).count() == 0


def test_language_id(docs, rows, empty):
    found = {r.doc_id: r for r in language_id.identify(docs).select("doc_id", "lang_pred", language_id.held_out(F.col("doc_id")).alias("h"), F.col("score").alias("p")).collect()}
    assert all(found[i].h == (zlib.crc32(str(i).encode()) % 4 == 2) for i in found if i is not None) and not found[None].h
    assert [found[i].lang_pred for i in (300, 301, 302, 303)] == ["und"] * 4
    held = [(found[i].lang_pred, lang) for i, t, lang, *_ in rows if i is not None and i < 120 and found[i].h and len(t) > 40]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)
    assert all(0 <= r.p <= 1 for r in found.values())
    kept = language_id.stage_language(docs.sparkSession, docs, "")
    assert kept.columns == docs.columns and 0 < kept.count() < len(rows)
    assert language_id.identify(empty).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_windows_cover_every_byte():
    rng = np.random.default_rng(0)
    for n in (0, 1, 191, 192, 193, 1000, 5000):
        data = rng.integers(97, 123, n).astype(np.uint8)
        symbols, owner, size = language_id.cut(data, np.array([0]), np.array([n]))
        grams = {bytes(data[i:i + 5]) for i in range(n - 4)}
        seen = {bytes(w[j:j + 5].astype(np.uint8)) for w in symbols for j in range(len(w) - 4) if (w[j:j + 5] < 256).all()}
        assert grams == seen


def brute_links(rows, k, percent):
    sets = {}
    for i, t, *_ in rows:
        w = words(t)
        if i is not None:
            sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_jaccard_join(docs, rows, empty, k, percent):
    label, sizes = brute_links(rows, k, percent)
    got = jaccard_join.join(docs, k, percent).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.component_id, r.n_shingles) == (label[r.doc_id], sizes[r.doc_id]), r
    assert jaccard_join.join(empty, k, percent).count() == 0


def near_group():
    """Many near copies that are mostly not linked with each other: regions that stay open after the first round."""
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(150):
        own = list(base)
        for p in rng.integers(0, 100, int(rng.integers(0, 6))):
            own[p] = f"x{rng.integers(0, 40)}"
        rows.append((i, " ".join(own), "en", "s", 1))
    return rows


@pytest.mark.parametrize("small,tile", [(32, 128), (4, 8)])
def test_jaccard_join_of_one_near_group(spark, monkeypatch, small, tile):
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    rows = near_group()
    label, _ = brute_links(rows, 3, 90)
    assert 3 < len(set(label.values())) < 140
    assert {r.doc_id: r.component_id for r in jaccard_join.join(spark.createDataFrame(rows, SCHEMA), 3, 90).collect()} == label


def test_token_files(docs, rows, empty, tmp_path):
    from tokenizers import Tokenizer
    path = tokens.vocabulary("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    token_files.write(docs, f"file://{tmp_path}/a", path)
    got = token_files.read(docs.sparkSession, f"file://{tmp_path}/a", ids=True).collect()
    expected = sorted(((i is not None, i or 0, t or ""), [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]) for i, t, *_ in rows)
    got = sorted(got, key=lambda r: r.start)
    at = 0
    for r, ((known, i, _), ids) in zip(got, expected, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i if known else None, at, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4"))
        at += len(ids)
    token_files.write(empty, f"file://{tmp_path}/b", path)
    assert token_files.read(docs.sparkSession, f"file://{tmp_path}/b").count() == 0


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer
    path = tokens.vocabulary("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    packed = packing.pack(docs, path).cache()
    got = packed.collect()
    expected = collections.Counter()
    for i, t, *_ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        for s in range(0, len(ids), 4096):
            expected[i, s, len(ids[s:s + 4096]), zlib.crc32(ids[s:s + 4096]), len(ids)] += 1
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == expected
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert sum(r.length for r in got) > 0.8 * 4096 * (len(by) - 1)
    assert packing.pack(empty, path).count() == 0
    whole = packing.sequences(docs.dropDuplicates(["doc_id", "text"]), packing.pack(docs.dropDuplicates(["doc_id", "text"]), path), path).collect()
    assert all(len(r.ids) == 4096 or len(r.ids) & (len(r.ids) - 1) == 0 for r in whole)


def test_patterns_hold_all_pieces():
    rng = np.random.default_rng(4)
    for n in (0, 1, 50, 3000):
        counts = np.bincount(rng.integers(0, 63, n), minlength=64)
        plan = packing.patterns(counts, 64)
        assert sum((p * t for p, t in plan), np.zeros(64, np.int64)).tolist() == counts.tolist()
        assert all((p * np.arange(1, 65)).sum() <= 64 for p, _ in plan)
        if n == 3000:
            assert sum(t for _, t in plan) <= 1.02 * (counts * np.arange(1, 65)).sum() / 64 + 2


def test_pieces_equal_whole_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer
    texts = [None, "", " ", "  ", "a  b", "a \n b", " lead", "trail ", "a<|endoftext|> b <|endoftext|>c", "don't  we'll", "ﬁ é x", "日本 語", "a\x1c \x1cb", "\n\n x", " 　 q", "a\xa0 \xa0b", "Word Word word", "x " * 500]
    for name, blanks in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        tokenizer, own = Tokenizer.from_file(tokens.vocabulary(name)), tokens.Pieces(tokens.vocabulary(name), blanks)
        for _ in range(2):
            ids, counts = own.encode(pa.array(texts).slice(1))
            ends = np.cumsum(counts)
            assert [ids[e - n:e].tolist() for e, n in zip(ends, counts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts[1:]]


def test_suffix_tree(docs, rows, empty):
    got = suffix_tree.score(docs).collect()
    assert len(got) == len(rows)
    count = collections.Counter()
    for i, t, *_ in rows:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            count.update([*words(t), "\n"])
    n, v = sum(count.values()), len(count)
    by = collections.defaultdict(list)
    for i, t, *_ in rows:
        w = [*words(t), "\n"]
        by[i].append((len(w), sum(count[x] > 0 for x in w), sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)))
    for r in got:
        assert r.train_tokens == n and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert any((r.n_tokens, r.n_known) == (a, b) and r.base_score == pytest.approx(c) for a, b, c in by[r.doc_id])
        assert r.score < 0
    assert suffix_tree.score(empty).count() == 0


def test_license_scan(docs, rows, empty):
    token = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    by = collections.defaultdict(list)
    for i, t, *_ in rows:
        w = token.findall((t or "").translate(FOLD))
        places = [(k, label) for label, _, phrase in license_rules.BASE for k in range(len(w)) if w[k:k + len(phrase.split())] == phrase.split()]
        by[i].append((len(w), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None), ",".join(sorted({x for _, x in places}))))
    got = license_scan.scan(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) in by[r.doc_id]
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert next(r for r in got if r.doc_id == 401).n_base == 4
    assert license_scan.scan(empty).count() == 0


def test_license_overlaps(spark):
    text = "SPDX-License-Identifier: MIT license. Licensed under the GNU Lesser General Public License version 2.1, not the MIT-0 license; This work is under CC-BY-NC-SA 4.0"
    got = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.labels == "cc-by-nc,cc-by-nc-sa,lgpl-2.1,mit,mit-0" and got.base_labels == "cc-by-nc"
    rules = license_rules.rules()
    assert len(rules) > 200 and all(re.compile(p.replace("(?= )", "")) for _, _, p, *_ in rules)


def test_exact_dedup_stage_tells_rows_of_one_id_apart(spark):
    """A copy goes even where another row of its id stays; wholly equal rows are one; extra and clashing columns stay as they are."""
    from tidemark.llm.exact_dedup import stage_exact_dedup
    rows = [(1, "a", 10), (2, "b", 20), (2, "a", 21), (3, "c", 30), (3, "c", 30), (None, "d", 40), (None, " d", 41), (None, "a", 42), (4, None, 50), (5, "", 51), (6, "b  ", 60), (6, "e", 61)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int").repartition(3)
    got = sorted(((r.doc_id, r.text, r.kept) for r in stage_exact_dedup(spark, docs, "").collect()), key=str)
    assert sorted((i, t) for i, t, _ in got if i is not None) == [(1, "a"), (2, "b"), (3, "c"), (4, None), (6, "b  "), (6, "e")]
    assert [t for i, t, _ in got if i is None] in (["d"], [" d"], ["d", " d"], [" d", "d"])
    assert stage_exact_dedup(spark, docs.limit(0), "").columns == ["doc_id", "text", "kept"]
