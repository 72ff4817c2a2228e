"""Exact Jaccard join of word-shingle sets as a metric-space join: pivots, Voronoi regions, triangle-inequality windows, recursion.

Jaccard distance is a metric, but unrelated texts are all at distance 1 of each other, so documents as first pivots would leave everything in
every region. The first pivots are therefore single shingles: a set is at distance 1 - 1/n of each shingle it holds and at 1 of all others. Ties
go to the rarest shingle, then to the least digest, which makes the rarest shingle of a set its nearest pivot. Two sets within the threshold can
differ in so few shingles that they share one of their first n - ceil(t n) + 1; a set is copied to the regions of that window and no further.

Inside a region the pivot is its most ordinary member. Round one measures every set against one pivot; sets within the threshold of it
are one component and need no comparison with each other. Regions whose members are in several components are joined on: small ones pair
by pair, pairs first tested in a contraction of the metric (sets counted into 64 slots: distances only shrink, so nothing is lost); large ones
recursively: connected large regions merge, each measures its members against one pivot document, and by the triangle inequality a ring of
that distance meets only itself and the next ring; tiles of rings are joined exactly and return a spanning forest.

Equal sets are one node throughout. Rarity only orders shingles; it comes from counts over all documents, and results do not depend on it.

Defined cases: texts that are null or without words have no set and link with nothing; shorter texts than a shingle are one shingle; a null
doc_id links with nothing and has no component; rows that repeat a doc_id are one document for components; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import keep_rows, query, sliced, staged_small, table
from tidemark.llm.components import components
from tidemark.staging import stage

#: Shingles counted as frequent are at most this many (16 bytes each, in every worker): all from the least power of two that leaves no more.
FREQUENT = 1 << 20
#: A batch reports shingles that this many of its documents hold.
REPORTED = 2
#: Bytes of text whose shingles are made at a time.
SLICE = 1 << 21
#: Slots of the contraction; members up to which a region is joined pair by pair; sets of one side of a tile.
SLOTS, SMALL, TILE = 64, 512, 128
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _B
    return h ^ (h >> np.uint64(29))


def shingle_sets(texts: pa.Array, k: int):
    """(digests of the distinct k-word shingles of each text, sorted, one text after another; their number per text)."""
    import xxhash
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    flat, offsets = split.flatten(), split.offsets.to_numpy().astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0)
    words = np.diff(np.append(0, np.cumsum(full.to_numpy(zero_copy_only=False)))[offsets - offsets[0]])
    coded = flat.filter(full).dictionary_encode()
    digest = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
    h = digest[coded.indices.to_numpy()]
    grams = h[:max(0, len(h) - k + 1)].copy()
    for i in range(1, k):
        grams = _mixed(grams * _A + h[i:len(h) - k + 1 + i])
    ends = np.cumsum(words)
    sets, sizes = [], np.zeros(len(words), np.int64)
    for d, (n, end) in enumerate(zip(words.tolist(), ends.tolist())):
        if n >= k:
            own = np.unique(grams[end - n:end - k + 1])
        elif n:
            own = np.array([n], np.uint64)
            for x in h[end - n:end]:
                own = _mixed(own * _C + x)
        else:
            continue
        sets.append(own)
        sizes[d] = len(own)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), sizes


def _signature(own: np.ndarray) -> int:
    return int(_mixed(own * _A + _C).sum(dtype=np.uint64).astype(np.int64))


def _each(flat: np.ndarray, sizes: np.ndarray):
    at = 0
    for d, n in enumerate(sizes.tolist()):
        if n:
            yield d, flat[at:at + n]
        at += n


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def survey(docs: DataFrame, k: int) -> DataFrame:
    """Staged: kind 0: doc_id, n (set size), id (signature of the set), slots (the set counted into SLOTS); kind 1: id (a shingle), n (documents of a batch that hold it)."""

    def rows(batch):
        for some in sliced([batch], SLICE):
            flat, sizes = shingle_sets(some.column(1), k)
            ids, slots = np.zeros(len(sizes), np.int64), np.zeros((len(sizes), SLOTS), np.int32)
            for d, own in _each(flat, sizes):
                ids[d] = _signature(own)
                slots[d] = np.bincount((own & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
            counted = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * SLOTS), pa.array(slots.reshape(-1)))
            yield flat, pa.RecordBatch.from_pydict({"kind": pa.array(np.zeros(len(sizes), np.int32)), "doc_id": some.column(0), "n": pa.array(sizes), "id": pa.array(ids), "slots": counted})

    def run(batches):
        for batch in batches:
            held = []
            for flat, out in rows(batch):
                held.append(flat)
                yield out
            shingles, counts = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            held.clear()
            keep = counts >= REPORTED
            n = int(keep.sum())
            yield pa.RecordBatch.from_pydict({"kind": pa.array(np.ones(n, np.int32)), "doc_id": pa.nulls(n, pa.int64()), "n": pa.array(counts[keep].astype(np.int64)), "id": pa.array(shingles[keep].view(np.int64)), "slots": pa.nulls(n, pa.list_(pa.int32()))})

    return stage(_source(docs).mapInArrow(run, "kind int, doc_id long, n long, id long, slots array<int>"), "jaccard-survey")


def frequent(surveyed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The frequent shingles, sorted, and their counts; FREQUENT at most."""
    sums = stage(surveyed.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= 2 * REPORTED), "jaccard-frequent")
    least, held = 1 << 62, 0
    for r in sums.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("power")).collect():  # 63 rows at most
        held += r["n"]
        if held > FREQUENT:
            break
        least = 1 << r["power"]
    found = sums.where(F.col("n") >= least).toArrow()
    shingles, counts = found["id"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(shingles)
    return shingles[order], counts[order]


def windows(docs: DataFrame, k: int, percent: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Staged: a row for each region of each set: key (pivot shingle), id, n, pos (place of the pivot among the set's, from 1), rare (shingles that are not frequent)."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        shingles, counts = shared.value
        for batch in sliced(batches, SLICE):
            flat, sizes = shingle_sets(batch.column(1), k)
            often = np.zeros(len(flat), np.int64)
            if len(shingles):
                at = np.minimum(np.searchsorted(shingles, flat), len(shingles) - 1)
                often = np.where(shingles[at] == flat, counts[at], 0)
            keys, ids, ns, places, rares, at = [], [], [], [], [], 0
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for d, own in _each(flat, sizes):
                seen, n = often[at:at + len(own)], len(own)
                at += n
                if not known[d]:
                    continue
                size = n - -(-percent * n // 100) + 1
                keys.append(own[:size] if not seen.any() else own[np.argsort(seen, kind="stable")[:size]])
                ids.append(np.full(size, _signature(own)))
                ns.append(np.full(size, n))
                places.append(np.arange(1, size + 1))
                rares.append(np.full(size, n - np.count_nonzero(seen)))
            join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
            yield pa.RecordBatch.from_pydict({"key": pa.array(join(keys, np.uint64).view(np.int64)), "id": pa.array(join(ids, np.int64)), "n": pa.array(join(ns, np.int32)), "pos": pa.array(join(places, np.int32)), "rare": pa.array(join(rares, np.int32))})

    return stage(_source(docs).mapInArrow(run, "key long, id long, n int, pos int, rare int"), "jaccard-windows")


def sets_of(docs: DataFrame, profile: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """Staged sets of the given ids (one column): id, n, items. Reads the texts of their first documents only."""

    def run(batches):
        for batch in sliced(batches, SLICE):
            flat, sizes = shingle_sets(batch.column(1), k)
            own = [x for _, x in _each(flat, sizes)]
            yield pa.RecordBatch.from_pydict({"id": pa.array([_signature(x) for x in own], pa.int64()), "n": pa.array([len(x) for x in own], pa.int32()), "items": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes[sizes > 0])).astype(np.int32)), pa.array(flat.view(np.int64)))})

    wanted, _ = staged_small(ids.toDF("w").distinct(), "jaccard-ids")
    firsts = profile.join(wanted, profile["id"] == wanted["w"], "left_semi").select("first").distinct()
    rows = keep_rows(_source(docs), firsts, "jaccard-wanted").mapInArrow(run, "id long, n int, items array<long>")
    return stage(rows.groupBy("id").agg(F.first("n").alias("n"), F.first("items").alias("items")), "jaccard-sets")


def _enough(both, na, nb, percent: int):
    return 100 * both >= percent * (na + nb - both)


def linked(docs: DataFrame, profile: DataFrame, pairs: DataFrame, k: int, percent: int, name: str) -> DataFrame:
    """Those of `pairs` (a, b) whose sets are similar enough: first in the contraction, the rest exactly."""
    side = lambda c: profile.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("slots").alias(f"s{c}"))
    both = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    near, n = staged_small(pairs.join(side("a"), "a").join(side("b"), "b").where(_enough(both, F.col("na"), F.col("nb"), percent)).select("a", "b"), f"{name}-near")
    if n == 0:
        return pairs.limit(0).select("a", "b")
    sets = sets_of(docs, profile, near.select("a").unionByName(near.select(F.col("b").alias("a"))), k)
    left, right = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("items").alias("ia")), sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("items").alias("ib"))
    exact = left.join(near, "a").join(right.join(near.select("b").distinct(), "b", "left_semi"), "b")
    return stage(exact.where(_enough(F.size(F.array_intersect("ia", "ib")), F.col("na"), F.col("nb"), percent)).select("a", "b"), f"{name}-links")


def _possible(percent: int):
    """Sizes, and the places of a shared pivot if it is the first they share, leave room for the threshold; a pair is sure to pass at its first."""
    need = F.ceil(F.lit(percent) * (F.col("x.n") + F.col("y.n")) / F.lit(100 + percent))
    return (1 + F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) >= need)


def _overlaps(rows: list[np.ndarray], cols: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, through the incidence of the items that both sides hold."""
    ra, rb = np.concatenate(rows), np.concatenate(cols)
    items = np.intersect1d(ra, rb)
    oa, ob = np.repeat(np.arange(len(rows)), [len(x) for x in rows]), np.repeat(np.arange(len(cols)), [len(x) for x in cols])
    out = np.zeros((len(rows), len(cols)), np.float32)
    for i in range(0, len(items), 1 << 14):
        some = items[i:i + (1 << 14)]
        sides = []
        for flat, owner, n in ((ra, oa, len(rows)), (rb, ob, len(cols))):
            at = np.minimum(np.searchsorted(some, flat), len(some) - 1)
            hit = some[at] == flat
            m = np.zeros((n, len(some)), np.float32)
            m[owner[hit], at[hit]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def tile_links(ids: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the left and the right sets of a tile that are in different components."""
    both = _overlaps([sets[i] for i in left], [sets[j] for j in right])
    n = np.array([len(s) for s in sets])
    near = (100 * both >= percent * (n[left][:, None] + n[right] - both)) & (labels[left][:, None] != labels[right])
    root, out = dict(zip(labels.tolist(), labels.tolist())), []

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in zip(*np.nonzero(near)):
        a, b = top(int(labels[left[i]])), top(int(labels[right[j]]))
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((int(ids[left[i]]), int(ids[right[j]])))
    return out


def _labels(links: DataFrame, name: str) -> DataFrame:
    return staged_small(components(links, name), f"{name}-labels")[0]


def _label(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, rows["id"] == labels["node"], "left").withColumn("label", F.coalesce("component", "id")).drop("node", "component")


def _rings(docs: DataFrame, profile: DataFrame, members: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) inside large regions. members: key, id, label, pivot."""
    regions = components(members.select(F.col("id").alias("a"), F.col("pivot").alias("b")), "jaccard-regions")
    own = members.select("id", "label").distinct()
    own = own.join(regions, own["id"] == regions["node"], "left").select("id", "label", F.coalesce("component", "id").alias("region"))
    own, _ = staged_small(own, "jaccard-region-members")
    # one pivot document for each region; its distance to all members
    sets = sets_of(docs, profile, own.select("id"), k)
    chosen, _ = staged_small(own.select("region").distinct(), "jaccard-region-pivots")
    pivots = sets.select(F.col("id").alias("region"), F.col("items").alias("pivot_items"), F.col("n").alias("pivot_n")).join(chosen, "region", "left_semi")
    both = F.size(F.array_intersect("items", "pivot_items"))
    measured = own.join(sets.select("id", "n", "items"), "id").join(pivots, "region")
    step = 100 - percent
    # whole numbers: the ring of a distance is the distance over the threshold, rounded down
    ring = F.floor(F.lit(100) * (F.col("n") + F.col("pivot_n") - 2 * both) / (F.lit(step) * (F.col("n") + F.col("pivot_n") - both))).cast("int")
    ringed = stage(measured.select("region", "id", "label", "items", ring.alias("ring")), "jaccard-rings")
    sizes = ringed.groupBy("region", "ring").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("blocks"))
    dealt = ringed.join(sizes, ["region", "ring"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    further = sizes.select("region", (F.col("ring") - 1).alias("ring"), F.col("blocks").alias("outer"))
    inner = sizes.select("region", (F.col("ring") + 1).alias("ring"), F.col("blocks").alias("inner"))
    dealt = dealt.join(further, ["region", "ring"], "left").join(inner, ["region", "ring"], "left")
    # tiles of a ring with itself, with the next ring (as left side), and with the one before (as right side)
    tiles = F.flatten(F.array(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.col("ring").alias("r"), F.lit(0).alias("step"), F.least(b, F.col("block")).alias("i"), F.greatest(b, F.col("block")).alias("j"), F.lit(0).alias("side"))),
        F.when(F.col("outer") > 0, F.transform(F.sequence(F.lit(0), F.col("outer") - 1), lambda b: F.struct(F.col("ring").alias("r"), F.lit(1).alias("step"), F.col("block").alias("i"), b.alias("j"), F.lit(1).alias("side")))).otherwise(F.array()),
        F.when(F.col("inner") > 0, F.transform(F.sequence(F.lit(0), F.col("inner") - 1), lambda b: F.struct((F.col("ring") - 1).alias("r"), F.lit(1).alias("step"), b.alias("i"), F.col("block").alias("j"), F.lit(2).alias("side")))).otherwise(F.array())))
    spread = dealt.select("region", "id", "label", "items", "block", F.explode(tiles).alias("t")).select("region", "t.r", "t.step", "t.i", "t.j", "t.side", "id", "label", "items", "block")

    def run(t: pa.Table) -> pa.Table:
        ids, labels, side, block = (t[c].to_numpy() for c in ("id", "label", "side", "block"))
        items = [x.values.to_numpy() for x in t["items"].combine_chunks()]
        if t["step"][0].as_py():
            left, right = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
        else:
            left, right = np.flatnonzero(block == t["i"][0].as_py()), np.flatnonzero(block == t["j"][0].as_py())
        found = tile_links(ids, labels, items, left, right, percent) if len(left) and len(right) else []
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return spread.groupBy("region", "r", "step", "i", "j").applyInArrow(run, "a long, b long")


def join(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_shingles, component_id; texts link at a similarity of at least percent / 100."""
    surveyed = survey(docs, k)
    rows = surveyed.where("kind = 0").select("doc_id", F.col("n").alias("n_shingles"), "id")
    regions = windows(docs, k, percent, frequent(surveyed))
    # regions with at least two different sets, and their most ordinary member; they grow with the corpus, so the join shuffles at every size
    cells = stage(regions.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.min(F.struct("rare", "id", "n")).alias("p")).where("least < most")
                  .select("key", F.col("p.id").alias("pivot"), F.col("p.n").alias("pivot_n"), F.col("p.rare").alias("pivot_rare")), "jaccard-cells")
    live = stage(regions.join(cells, "key").select("key", "id", "n", "pos", "pivot", "pivot_n", "pivot_rare").distinct(), "jaccard-live")
    profile = stage(surveyed.where("kind = 0 and n > 0 and doc_id is not null").groupBy("id").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n").cast("int").alias("n"), F.first("slots").alias("slots")), "jaccard-profile")
    nodes = profile.select("id", "first")
    # round one: every set against one pivot of its regions
    fits = (100 * F.least("n", "pivot_n") >= percent * F.greatest("n", "pivot_n")) & (F.col("id") != F.col("pivot"))
    first = live.where(fits).groupBy("id").agg(F.min(F.struct("pivot_rare", "pivot")).alias("p")).select(F.col("id").alias("a"), F.col("p.pivot").alias("b"))
    links = linked(docs, profile, stage(first, "jaccard-first"), k, percent, "jaccard-one")
    labels = _labels(links, "jaccard-one")
    # regions that still hold several components
    named = _label(live.select("key", "id", "n", "pos", "pivot"), labels)
    open_, _ = staged_small(named.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count(F.lit(1)).alias("members")).where("least < most").select("key", "members"), "jaccard-open")
    still = stage(named.join(open_, "key"), "jaccard-still")
    small = still.where(F.col("members") <= SMALL)
    x, y = small.alias("x"), small.alias("y")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.label") != F.col("y.label")) & _possible(percent)).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    links = links.unionByName(linked(docs, profile, stage(pairs, "jaccard-pairs"), k, percent, "jaccard-two"))
    large = still.where(F.col("members") > SMALL)
    if not large.isEmpty():
        links = links.unionByName(_rings(docs, profile, large, k, percent))
    final = _labels(stage(links, "jaccard-all"), "jaccard-final")
    # the least doc_id of each component, and of each set
    firsts = _label(nodes, final).select("id", "first", "label")
    of_label = firsts.groupBy("label").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("sets")).where("sets > 1").select("label", "component_id")
    several, _ = staged_small(_label(final.select(F.col("node").alias("id")).unionByName(final.select(F.col("component").alias("id"))).distinct(), final).join(of_label, "label").select(F.col("id").alias("g"), "component_id"), "jaccard-several")
    copies, _ = staged_small(profile.where("copies > 1").select(F.col("id").alias("c"), F.col("first").alias("copy_of")), "jaccard-copies")
    done = rows.join(several, rows["id"] == several["g"], "left").join(copies, rows["id"] == copies["c"], "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    return done.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.coalesce("component_id", "copy_of", "doc_id")).alias("component_id"))


def stage_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the document with the least doc_id stays."""
    found = join(docs.select("doc_id", "text"), 5, 80)
    return keep_rows(docs, found.where(F.col("component_id").eqNullSafe(F.col("doc_id"))).select("doc_id").distinct(), "jaccard-kept")


@query("op5_jaccard_join")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents").select("doc_id", "text"))
