"""The suffix tree against one that counts every context of every length."""

import collections
import math
import zlib

import numpy as np
import pytest

from tidemark.llm import suffix_tree


def _tree(texts, depth, least):
    """Probability of the next byte after a context, by counting every context of every length."""
    seen = collections.defaultdict(collections.Counter)
    for t in texts:
        s = b"\n" * depth + t + b"\n"
        for i in range(depth, len(s)):
            for d in range(depth + 1):
                seen[s[i - d:i]][s[i]] += 1
    total = {c: sum(x.values()) for c, x in seen.items()}

    def kept(c):
        gain = sum(n * math.log(n / total[c] / (seen[c[1:]][s] / total[c[1:]])) for s, n in seen[c].items())
        return total[c] >= least and gain > 0.5 * len(seen[c]) * math.log(total[c])

    keep = {c for c in seen if c and kept(c)}

    def p(c, s):
        if not c:
            return (seen[b""][s] + 0.5) / (total[b""] + 128)
        return (seen[c][s] + len(seen[c]) * p(c[1:], s)) / (total[c] + len(seen[c])) if c in keep else p(c[1:], s)

    return p, keep


def test_suffix_tree_keeps_rare_contexts_beside_a_hot_source(spark):
    """Six occurrences of a spelling are enough, whatever their share of the corpus, and contexts have six bytes."""
    rng = np.random.default_rng(4)
    some = [" ".join("".join(rng.choice(list("abcdexy"), int(rng.integers(1, 9)))) for _ in range(60)) for _ in range(8)]
    texts = [*some, "qzxjvw" * 2 + " qzxjvwk", "qzxjvw qzxjvw qzxjvwk", "abcab " * 120_000, ""]
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 != 1][:len(texts)]
    held = [i for i in range(60) if i not in ids and zlib.crc32(str(i).encode()) % 5 == 1]
    tests = ["qzxjvwk abd", "éa unseen qzxjvw"]
    rows = [*zip(ids, texts), *zip(held, tests)]
    got = {r.doc_id: r.score for r in suffix_tree.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    p, keep = _tree([" ".join(t.split()).encode() for t in texts], 6, 2)
    positions = sum(len(" ".join(t.split())) + 1 for t in texts)
    assert b"z" in keep and "".join(texts).count("z") < 1e-5 * positions and any(len(c) == 6 for c in keep)
    count = collections.Counter(w for t in texts for w in [*t.split(), "\n"])
    share = lambda w: (count[w] + 0.5) / (sum(count.values()) + 0.5 * (len(count) + 1))
    for i, t in rows:
        if len(t) > 100_000:
            continue
        s, at, want = b"\n" * 6 + " ".join(t.split()).encode() + b"\n", 6, math.log10(share("\n"))
        for w in t.split():
            end = at + len(w.encode()) + 1
            want += math.log10((share(w) + math.exp(sum(math.log(p(s[k - 6:k], s[k])) for k in range(at, end)))) / 2)
            at = end
        assert got[i] == pytest.approx(want, rel=1e-5)
