"""Removal of repeated 100-byte strings by suffix arrays, built with the difference-cover algorithm (modulo 3) over dealt-out strings.

A string of WIDTH bytes that starts at i is a *window*. Its *anchor* is the leftmost GRAM-byte piece in it with the least digest, so equal windows
have equal anchors at the same place. The work:

1. `_seen`: every document's anchors, counted by a short code. A window whose anchor occurs once in the corpus is unique. Codes that a stretch
   of 4 MB sees twice are settled there and sent on once, so a frequent passage costs one entry a stretch.
2. `_strings`: consecutive windows with one anchor are one string (its *context*). Contexts of repeated anchors are dealt by anchor; those of
   anchors in more than HOT stretches are cut into single windows and dealt by their own digest. A block sends equal contexts once.
3. `_sorted`: each dealt group is suffix-sorted: triples at positions 1 and 2 modulo 3 are sorted and named, names are sorted in the same way
   until they differ, the other suffixes are merged in, and neighbours in the order are compared over WIDTH bytes. In each class of
   equal windows all but the first, by (doc_id, start), are repeats. Contexts equal in anchor and 64-bit digest are taken as equal.
4. `_cut`: the covered bytes are taken out of each document.

Documents move once, as blocks of about BLOCK bytes by a hash of the row, and the same exchange serves steps 2 and 4.

Defined cases: a null or empty text has no bytes and nothing removed; texts under 100 bytes never change; a very long text is one block of its own
size, worked through in steps of bounded size; rows that share a doc_id rank by digest of their text, and of wholly equal rows all but one are
removed; a null doc_id comes after every other id; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import query, table, whole
from tidemark.staging import stage

#: Production parameters: bytes of a repeated string, and of the piece that anchors it.
WIDTH, GRAM = 100, 40
#: Bytes of a block of documents; windows that one numpy step sees; positions of one suffix sort.
BLOCK, STEP, LEAF = 1 << 22, 1 << 21, 1 << 21
#: An anchor counted more often is dealt by whole windows, so that no suffix sort grows with a frequent passage.
HOT = 15_000
#: Anchors of a counting group, and windows of a sorting group, on average.
GROUP_ANCHORS, GROUP_BYTES = 600_000, 1 << 24

_M1, _M2, _B = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15
_CONTEXT = np.dtype([("key", "<u8"), ("digest", "<u8"), ("null", "u1"), ("doc_id", "<i8"), ("x", "<i8"), ("nth", "<u4"), ("start", "<i8"), ("at", "<i8"), ("n", "<u4")])
_powers: list[np.ndarray] = []


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(_M1)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(_M2)
    return h ^ (h >> np.uint64(33))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of the bytes, powers of an odd number modulo 2^64, and of its inverse."""
    if not _powers or len(_powers[1]) < n:
        up, down = np.full(n, _B, np.uint64), np.full(n, pow(_B, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [_mixed(np.arange(1, 257, dtype=np.uint64)), np.cumprod(up), np.cumprod(down)]
    return _powers[0], _powers[1], _powers[2]


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Least value of every `width` consecutive ones."""
    w = 1
    while w * 2 <= width:
        h = np.minimum(h[:-w], h[w:])
        w *= 2
    return np.minimum(h[:len(h) - (width - w)], h[width - w:]) if w < width else h


def anchors(data: np.ndarray, left: np.ndarray, width: int = WIDTH, gram: int = GRAM, hot: np.ndarray | None = None):
    """(start, n, key, digest) arrays of runs of windows with one anchor. `left[i]`: bytes of i's document from i on.

    Runs whose key is in the sorted array `hot` come as single windows with their own digest as the key.
    """
    parts = []
    place = np.uint64((1 << 23) - 1)
    for s in range(0, max(0, len(data) - width + 1), STEP):
        x = data[s:s + STEP + width - 1]
        n = len(x) - width + 1
        ok = left[s:s + n] >= width
        if not ok.any():
            continue
        value, up, down = _power_tables(STEP + width)
        total = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(value[x] * up[:len(x)], out=total[1:])
        h = _mixed((total[gram:] - total[:-gram]) * down[:len(x) - gram + 1])
        least = _least((h & ~place) | np.arange(len(h), dtype=np.uint64), width - gram + 1) & place
        edge = np.ones(n + 1, bool)
        edge[1:n] = (least[1:] != least[:-1]) | (ok[1:] != ok[:-1])
        first = np.flatnonzero(edge)
        first, size = first[:-1], np.diff(first)
        first, size = first[ok[first]], size[ok[first]]
        key = h[least[first].astype(np.int64)]
        if hot is not None and len(hot):
            split = np.isin(key, hot)
            repeat = np.where(split, size, 1)
            within = np.arange(int(repeat.sum())) - np.repeat(np.cumsum(repeat) - repeat, repeat)
            first, key, single = np.repeat(first, repeat) + within, np.repeat(key, repeat), np.repeat(split, repeat)
            size = np.where(single, 1, np.repeat(size, repeat))
        end = first + size + width - 1
        digest = _mixed((total[end] - total[first]) * down[first] + size.astype(np.uint64))
        if hot is not None and len(hot):
            key = np.where(single, digest, key)
        parts.append((first + s, size, key, digest))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(c) for c in zip(*parts))


def _key(*columns: tuple[np.ndarray, int]) -> list[np.ndarray]:
    """One int64 key per row of several columns (values, their bound); by multiplication where it fits, else by naming."""
    product = 1
    for _, bound in columns:
        product *= bound
    if product < 1 << 63:
        out = columns[0][0].astype(np.int64)
        for values, bound in columns[1:]:
            out = out * bound + values
        return out
    order = np.lexsort([v for v, _ in reversed(columns)])
    step = np.zeros(len(order), np.int64)
    for v, _ in columns:
        step[1:] |= v[order[1:]] != v[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(step)
    return out


def suffix_array(s: np.ndarray, bound: int) -> np.ndarray:
    """Suffix array of values in [1, bound) by the difference cover {1, 2} modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])
    n0, n1, n2 = (n + 2) // 3, (n + 1) // 3, n // 3
    # sampled suffixes: all at 1 modulo 3 (with an empty one where the last class would be short), then all at 2 modulo 3
    sample = np.concatenate([np.arange(n0) * 3 + 1, np.arange(n2) * 3 + 2])
    triple = _key((t[sample], bound), (t[sample + 1], bound), (t[sample + 2], bound))
    order = np.argsort(triple, kind="stable")
    step = np.ones(len(order), np.int64)
    step[1:] = triple[order[1:]] != triple[order[:-1]]
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(step)
    if step.all():
        ranked = order
    else:
        ranked = suffix_array(names, int(step.sum()) + 1)
        names[ranked] = np.arange(1, len(ranked) + 1)
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = names
    rank[n:] = 0  # what lies behind the end is less than anything
    top = len(sample) + 1
    # the others, by first value and the rank behind it
    rest = (ranked[ranked < n0]) * 3
    rest = rest[np.argsort(t[rest], kind="stable")]
    inner = sample[ranked[n0 - n1:]]
    one, two = inner[inner % 3 == 1], inner[inner % 3 == 2]
    both = np.concatenate([one, rest])
    k = _key((t[both], bound), (rank[both + 1], top))
    before = np.searchsorted(k[:len(one)], k[len(one):])
    both = np.concatenate([two, rest])
    k = _key((t[both], bound), (t[both + 1], bound), (rank[both + 2], top))
    before += np.searchsorted(k[:len(two)], k[len(two):])
    out = np.empty(n, np.int64)
    place = np.arange(len(rest)) + before
    free = np.ones(n, bool)
    free[place] = False
    out[place], out[free] = rest, inner
    return out


def _same(words: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Whether `width` bytes at a and b agree; words[i]: the eight bytes from i on."""
    offsets = [*range(0, width - 7, 8), *([width - 8] if width % 8 else [])]
    out = np.ones(len(a), bool)
    for o in offsets:
        out &= words[a + o] == words[b + o]
    return out


def repeats(text: np.ndarray, at: np.ndarray, n: np.ndarray, doc: np.ndarray, start: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Places in `text` of windows that are equal to an earlier one. Strings begin at `at`, hold n windows each and follow each other;
    doc: rank of a string's document, start: place of its first window there."""
    order = suffix_array(text.astype(np.int64) + 1, 257)
    mine = np.repeat(np.arange(len(at)), n)
    window = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    is_window = np.zeros(len(text), np.int64)
    is_window[window] = np.arange(1, len(window) + 1)
    found = is_window[order]
    found = found[found > 0] - 1  # windows in suffix order
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.zeros(len(text), np.uint64)
    for b in range(8):
        words |= padded[b:b + len(text)].astype(np.uint64) << np.uint64(8 * b)
    new = np.ones(len(found), bool)
    new[1:] = ~_same(words, window[found[:-1]], window[found[1:]], width)
    when = (doc[mine[found]].astype(np.int64) << 40) + (start[mine[found]] + window[found] - at[mine[found]])
    earliest = np.repeat(np.minimum.reduceat(when, np.flatnonzero(new)), np.diff(np.append(np.flatnonzero(new), len(new)))) if len(when) else when
    return np.sort(window[found[when > earliest]])


def _column(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, start of each text and end of the last)."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _left(bounds: np.ndarray) -> np.ndarray:
    size = np.diff(bounds)
    return np.repeat(bounds[1:], size) - np.arange(int(bounds[-1]))


def _groups(key: np.ndarray):
    """(value, first, end) of each run of a sorted array."""
    cut = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return zip(key[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(key)])


def _code(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(16)).astype(np.uint32)


_KNOWN = np.uint32(1 << 31)


def _seen(docs: DataFrame, groups: int, stretch: int, most: int) -> DataFrame:
    """(blk, codes): codes of repeated anchors for the block that holds them; blk = -1: (group, code) of those that are frequent everywhere."""

    def count(batches):
        for batch in batches:
            sizes = np.cumsum(np.diff(_column(batch.column(1))[1]))
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + stretch, "right")))
                data, bounds = _column(batch.column(1).slice(i, j - i))
                start, _, key, _ = anchors(data, _left(bounds))
                block = batch.column(0).slice(i, j - i).to_numpy().astype(np.uint32)[np.searchsorted(bounds, start, "right") - 1]
                i = j
                group, code = (key % np.uint64(groups)).astype(np.int64), _code(key)
                order = np.lexsort((block, code, group))
                group, code, block = group[order], code[order], block[order]
                first = np.append(True, (group[1:] != group[:-1]) | (code[1:] != code[:-1])) if len(code) else np.zeros(0, bool)
                n = np.diff(np.append(np.flatnonzero(first), len(code)))
                many = np.repeat(n > 1, n)
                # to the block: what this stretch has seen twice; to the group: each code once
                own = np.unique(np.stack([block[many], group[many].astype(np.uint32), code[many]]), axis=1) if many.any() else np.zeros((3, 0), np.uint32)
                rows = [(b % groups, b, own[1:, f:e].T.tobytes()) for b, f, e in _groups(own[0])]
                sent = np.where(n > 1, _KNOWN | n.astype(np.uint32), block[first])
                g, c = group[first], code[first]
                rows += [(k, -1, np.stack([c[f:e], sent[f:e]], axis=1).tobytes()) for k, f, e in _groups(g)]
                if rows:
                    yield pa.record_batch([pa.array(col, t) for col, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary()))], ["grp", "blk", "codes"])
            pa.default_memory_pool().release_unused()

    def settle(key, got):
        grp, blk, codes = key[0].as_py(), got.column("blk").to_numpy(), got.column("codes").to_pylist()
        rows = [(int(b), c) for b, c in zip(blk, codes) if b >= 0]
        sent = np.concatenate([np.zeros((0, 2), np.uint32), *(np.frombuffer(c, np.uint32).reshape(-1, 2) for b, c in zip(blk, codes) if b < 0)])
        sent = sent[np.lexsort((sent[:, 1], sent[:, 0]))]
        known = sent[:, 1] >= _KNOWN
        weight = np.where(known, sent[:, 1] & ~_KNOWN, 1).astype(np.int64)
        first = np.flatnonzero(np.append(True, sent[1:, 0] != sent[:-1, 0])) if len(sent) else np.zeros(0, np.int64)
        total = np.add.reduceat(weight, first) if len(first) else weight
        n = np.diff(np.append(first, len(sent)))
        again = np.repeat(total > 1, n) & ~known
        at = sent[again][np.argsort(sent[again][:, 1], kind="stable")]
        rows += [(int(b), np.stack([np.full(e - f, grp, np.uint32), at[f:e, 0]], axis=1).tobytes()) for b, f, e in _groups(at[:, 1])]
        frequent = sent[first[total > most], 0]
        if len(frequent):
            rows.append((-1, np.stack([np.full(len(frequent), grp, np.uint32), frequent], axis=1).tobytes()))
        return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["blk", "codes"])

    return docs.select("blk", "text").mapInArrow(count, "grp int, blk int, codes binary").groupBy("grp").applyInArrow(settle, "blk int, codes binary")


def _in_order(block: pa.Table) -> pa.Table:
    """Rows of a block by (doc_id, digests of the text), null ids last."""
    doc = block.column("doc_id")
    order = np.lexsort((block.column("c").to_numpy(), block.column("x").to_numpy(), doc.fill_null(0).to_numpy(), doc.is_null().to_numpy()))
    return block.take(pa.array(order)).combine_chunks()


def _member(group: np.ndarray, code: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether (group, code) is among the rows of `known`."""
    mine = (group.astype(np.uint64) << np.uint64(32)) | code
    return np.isin(mine, (known[:, 0].astype(np.uint64) << np.uint64(32)) | known[:, 1])


def _pairs(cells) -> np.ndarray:
    return np.concatenate([np.zeros((0, 2), np.uint32), *(np.frombuffer(c, np.uint32).reshape(-1, 2) for c in cells)])


def _strings(docs: DataFrame, seen: DataFrame, hot: np.ndarray, groups: int, shards: int) -> DataFrame:
    """(shard, blk, contexts, text): contexts of repeated anchors, dealt by anchor; text null: (place, bytes) already known to be repeats."""

    def send(key, block, codes):
        if block.num_rows == 0 or codes.num_rows == 0:
            return pa.table([pa.array([], pa.int32()), pa.array([], pa.int32()), pa.array([], pa.binary()), pa.array([], pa.binary())], names=["shard", "blk", "contexts", "text"])
        blk, block = key[0].as_py(), _in_order(block)
        data, bounds = _column(block.column("text").chunk(0))
        left = _left(bounds)
        known = _pairs(codes.column("codes").to_pylist())
        start, n, key0, digest = anchors(data, left)
        take = _member(key0 % np.uint64(groups), _code(key0), known)
        if len(hot):
            frequent = take & _member(key0 % np.uint64(groups), _code(key0), hot)
            if frequent.any():
                start, n, key0, digest = anchors(data, left, hot=np.unique(key0[frequent]))
                # a single window keeps its place among those to be sent
                single = key0 == digest
                take = _member(key0 % np.uint64(groups), _code(key0), known) | single
        start, n, key0, digest = start[take], n[take], key0[take], digest[take]
        order = np.lexsort((start, digest, key0))
        start, n, key0, digest = start[order], n[order], key0[order], digest[order]
        first = np.append(True, (key0[1:] != key0[:-1]) | (digest[1:] != digest[:-1])) if len(start) else np.zeros(0, bool)
        rows = []
        if not first.all():
            rows.append((blk % shards, blk, np.stack([start[~first], n[~first] + WIDTH - 1], axis=1).astype("<i8").tobytes(), None))
        start, n, key0, digest = start[first], n[first], key0[first], digest[first]
        at = np.searchsorted(bounds, start, "right") - 1
        out = np.zeros(len(start), _CONTEXT)
        doc = block.column("doc_id")
        out["key"], out["digest"], out["at"], out["n"], out["nth"] = key0, digest, start, n, at
        out["null"], out["doc_id"], out["x"] = doc.is_null().to_numpy()[at], doc.fill_null(0).to_numpy()[at], block.column("x").to_numpy()[at]
        out["start"] = start - bounds[at]
        shard = (_mixed(key0) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        out, shard = out[order], shard[order]
        for k, f, e in _groups(shard):
            size = out["n"][f:e].astype(np.int64) + WIDTH - 1
            pick = np.repeat(out["at"][f:e] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            rows.append((k, blk, out[f:e].tobytes(), pa.compress(data[pick].tobytes(), "zstd", asbytes=True)))
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["shard", "blk", "contexts", "text"])

    return docs.groupBy("blk").cogroup(seen.groupBy("blk")).applyInArrow(send, "shard int, blk int, contexts binary, text binary")


def _sorted(strings: DataFrame, leaf: int) -> DataFrame:
    """(blk, spans): (place, bytes) of repeats in each block."""

    def order_group(key, got):
        blks, cells, texts = got.column("blk").to_numpy(), got.column("contexts").to_pylist(), got.column("text").to_pylist()
        rows = [(int(b), c) for b, c, t in zip(blks, cells, texts) if t is None]
        parts = [(int(b), np.frombuffer(c, _CONTEXT), t) for b, c, t in zip(blks, cells, texts) if t is not None]
        if parts:
            con = np.concatenate([c for _, c, _ in parts])
            blk = np.repeat(np.array([b for b, _, _ in parts], np.int64), [len(c) for _, c, _ in parts])
            size = con["n"].astype(np.int64) + WIDTH - 1
            text = np.concatenate([np.frombuffer(pa.decompress(t, int((c["n"].astype(np.int64) + WIDTH - 1).sum()), "zstd"), np.uint8) for _, c, t in parts])
            begin = np.cumsum(size) - size
            order = np.lexsort((con["at"], blk, con["start"], con["nth"], con["x"], con["doc_id"], con["null"], con["digest"], con["key"]))
            con, blk, size, begin = con[order], blk[order], size[order], begin[order]
            new_key = np.append(True, con["key"][1:] != con["key"][:-1])
            first = new_key | np.append(True, con["digest"][1:] != con["digest"][:-1])
            hit_blk, hit_at, hit_n = [blk[~first]], [con["at"][~first]], [size[~first]]
            # anchors with one context are done; the others are sorted, as many at a time as a leaf holds
            of = np.cumsum(new_key) - 1
            alone = np.bincount(of[first], minlength=of[-1] + 1) == 1
            keep = np.flatnonzero(first & ~alone[of])
            con, blk, size, begin, of = con[keep], blk[keep], size[keep], begin[keep], of[keep]
            _, doc = np.unique(np.stack([con["null"].astype(np.int64), con["doc_id"], con["x"], blk, con["nth"].astype(np.int64)]), axis=1, return_inverse=True) if len(con) else (None, np.zeros(0, np.int64))
            total, f = np.cumsum(size), 0
            while f < len(con):
                e = max(f + 1, int(np.searchsorted(total, (total[f - 1] if f else 0) + leaf, "right")))
                if e < len(con):
                    back = int(np.searchsorted(of, of[e]))  # never within an anchor
                    e = back if back > f else int(np.searchsorted(of, of[f], "right"))
                own = size[f:e]
                at = np.cumsum(own) - own
                piece = text[np.repeat(begin[f:e] - at, own) + np.arange(int(own.sum()))]
                hits = repeats(piece, at, con["n"][f:e].astype(np.int64), doc.ravel()[f:e], con["start"][f:e])
                which = np.searchsorted(at, hits, "right") - 1
                edge = np.append(True, (hits[1:] != hits[:-1] + 1) | (which[1:] != which[:-1])) if len(hits) else np.zeros(0, bool)
                run = np.flatnonzero(edge)
                hit_blk.append(blk[f:e][which[run]])
                hit_at.append(con["at"][f:e][which[run]] + hits[run] - at[which[run]])
                hit_n.append(np.diff(np.append(run, len(hits))) + WIDTH - 1)
                f = e
            hb, ha, hn = (np.concatenate(c) for c in (hit_blk, hit_at, hit_n))
            order = np.argsort(hb, kind="stable")
            hb, spans = hb[order], np.stack([ha[order], hn[order]], axis=1).astype("<i8")
            rows += [(b, spans[f:e].tobytes()) for b, f, e in _groups(hb)]
        pa.default_memory_pool().release_unused()
        return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["blk", "spans"])

    return strings.groupBy("shard").applyInArrow(order_group, "blk int, spans binary")


def _cut(docs: DataFrame, spans: DataFrame) -> DataFrame:

    def cut(key, block, found):
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
        if block.num_rows == 0:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())], names=names)
        block = _in_order(block)
        data, bounds = _column(block.column("text").chunk(0))
        n = len(data)
        span = np.concatenate([np.zeros((0, 2), np.int64), *(np.frombuffer(c, "<i8").reshape(-1, 2) for c in found.column("spans").to_pylist())])
        depth = np.bincount(span[:, 0], minlength=n + 1)[:n + 1] - np.bincount(span[:, 0] + span[:, 1], minlength=n + 1)[:n + 1]
        gone = np.cumsum(depth)[:n] > 0
        # spans never leave their document, so a run of removed bytes begins at a document's start or behind a kept byte
        begins = gone & ~np.append(False, gone[:-1])
        begins[bounds[:-1][np.diff(bounds) > 0]] = gone[bounds[:-1][np.diff(bounds) > 0]]
        sums, starts = np.append(0, np.cumsum(gone)), np.append(0, np.cumsum(begins))
        removed, runs = sums[bounds[1:]] - sums[bounds[:-1]], starts[bounds[1:]] - starts[bounds[:-1]]
        kept = data[~gone].tobytes()
        ends = bounds[1:] - sums[bounds[1:]]
        kept = [kept[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        return pa.table([block.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], names=names)

    return docs.groupBy("blk").cogroup(spans.groupBy("blk")).applyInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def dedup(docs: DataFrame, block: int = BLOCK, hot: int = HOT, leaf: int = LEAF, group_anchors: int = GROUP_ANCHORS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): each document's bytes without those covered by a string of WIDTH bytes that starts earlier."""
    text = whole(F.col("text").cast("string"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block))
    groups = max(1, -(-size // (28 * group_anchors)))
    rows = rows.withColumn("x", F.xxhash64("text"))
    rows = rows.withColumn("c", F.crc32("text")).withColumn("blk", F.pmod(F.xxhash64("doc_id", "x"), F.lit(blocks)).cast("int")).select("blk", "doc_id", "text", "x", "c")
    seen = stage(_seen(rows, groups, block, hot), "suffix-seen")
    frequent = _pairs(r[0] for r in seen.where("blk < 0").select("codes").toLocalIterator())  # at most one in HOT anchors
    strings = _strings(rows, seen.where("blk >= 0"), frequent, groups, max(1, -(-size // group_bytes)))
    return _cut(rows, _sorted(strings, leaf))


@query("op11_suffix_dedup")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
