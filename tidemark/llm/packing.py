"""Packing documents into sequences as a cutting-stock problem, solved by column generation on the histogram of lengths.

A document is cut at every full sequence; what is left over is rounded up to a class of GRAIN tokens. Only the histogram of classes (at most
LIMIT / GRAIN numbers) reaches the driver. There a linear program over patterns (how many pieces of which class share a sequence) is solved by
the revised simplex method; a knapsack dynamic program over the duals prices the columns. Patterns rounded down are used that often, and what
they leave is filled greedily, largest piece first. Pieces are ranked within their class, and ranks are dealt to the patterns in order.

Ranks need no window over a class: a class is split into hashed buckets, each bucket starts at the prefix sum of the buckets before it.

Defined cases: a null or empty text is its end id alone; rows that repeat a doc_id or text are packed one by one; a null doc_id stays null; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, query, staged_small, table
from tidemark.llm.tokens import pieces, small_batches, vocabulary
from tidemark.staging import stage

#: Production parameters: tokens of a sequence, width of a length class, id that ends a document.
LIMIT, GRAIN, END = 4096, 32, 2
#: Rows that a bucket of a class has on average.
BUCKET_ROWS = 50_000
#: Bytes of text that are tokenized at a time: little, since in the pipeline the executors are already full when packing begins.
STEP = 1 << 20
#: Pieces that a worker remembers, and documents of an Arrow batch, for the same reason.
MEMORY, ROWS = 200_000, 1000
#: The program stops when its bound is this near.
GAP = 5e-4


def knapsack(worth: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """best[w]: the most worth that fits in w, worth[c] for a piece of size c + 1, any number of each; took[w]: a piece of such a filling, or 0."""
    best, took = np.zeros(room + 1), np.zeros(room + 1, np.int64)
    for w in range(1, room + 1):
        values = best[w - 1::-1][:len(worth)] + worth[:w]
        k = int(values.argmax())
        best[w], took[w] = (values[k], k + 1) if values[k] > best[w - 1] else (best[w - 1], 0)
    return best, took


def filling(took: np.ndarray, w: int, n: int) -> np.ndarray:
    """The pieces that `knapsack` put into w."""
    pattern = np.zeros(n, np.int64)
    while w > 0:
        if took[w]:
            pattern[took[w] - 1] += 1
        w -= took[w] or 1
    return pattern


def patterns(counts: np.ndarray, room: int, gap: float = GAP) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) that together hold exactly counts[c] pieces of size c + 1, in few sequences of `room`."""
    need = counts.astype(np.int64).copy()
    sizes = np.flatnonzero(need) + 1
    out: list[tuple[np.ndarray, int]] = []
    if len(sizes) == 0:
        return out
    n = need[sizes - 1].astype(float)
    # one pattern of each size alone to begin with
    columns = np.diag((room // sizes).astype(float))
    inverse = np.diag(1 / np.diag(columns))
    level = inverse @ n
    worth = np.zeros(room)
    while True:
        dual = inverse.sum(axis=0)
        worth[sizes - 1] = np.maximum(dual, 0)
        best, took = knapsack(worth, room)
        if best[room] <= 1 + 1e-9 or dual @ n / best[room] >= (1 - gap) * level.sum():  # duals over the best price bound from below
            break
        # the best pattern around each piece; those that still pay after the pivots before them enter too
        for c in sizes[np.argsort(-(worth[sizes - 1] + best[room - sizes]))]:
            pattern = filling(took, room - c, room)
            pattern[c - 1] += 1
            enter = pattern[sizes - 1].astype(float)
            if inverse.sum(axis=0) @ enter <= 1 + 1e-9:
                continue
            step = inverse @ enter
            ratio = np.where(step > 1e-9, level / np.where(step > 1e-9, step, 1), np.inf)
            leave = int(ratio.argmin())
            move = ratio[leave]
            level -= move * step
            level[leave] = move
            row = inverse[leave] / step[leave]
            inverse -= np.outer(step, row)
            inverse[leave] = row
            columns[:, leave] = enter
    for k in np.argsort(-level, kind="stable"):
        pattern = np.zeros(room, np.int64)
        pattern[sizes - 1] = np.rint(columns[:, k])
        used = pattern > 0
        times = int(min(np.floor(level[k] + 1e-7), (need[used] // pattern[used]).min()))
        if times > 0:
            out.append((pattern, times))
            need -= pattern * times
    while need.any():
        pattern, left = np.zeros(room, np.int64), room
        while left:
            fit = np.flatnonzero((need - pattern)[:left] > 0)
            if not len(fit):
                break
            c = int(fit[-1])
            take = int(min(left // (c + 1), need[c] - pattern[c]))
            pattern[c] += take
            left -= take * (c + 1)
        used = pattern > 0
        times = int((need[used] // pattern[used]).min())
        out.append((pattern, times))
        need -= pattern * times
    return out


def cut(docs: DataFrame, path: str, limit: int = LIMIT, end: int = END) -> DataFrame:
    """(doc_id, text) -> one row per piece: doc_id, start, length, ids_crc32, doc_tokens."""

    def run(batches):
        words = pieces(path, blanks=False, memory=MEMORY)
        for batch in small_batches(batches, step=STEP):
            ids, counts = words.encode(batch.column(1))
            doc, start, length, crc, total, at = [], [], [], [], [], 0
            for k, n in enumerate(counts.tolist()):
                own = np.append(ids[at:at + n], np.uint32(end)).astype("<u4")
                at += n
                for s in range(0, n + 1, limit):
                    piece = own[s:s + limit]
                    doc.append(k)
                    start.append(s)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece))
                    total.append(n + 1)
            yield pa.record_batch([batch.column(0).take(pa.array(doc, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(total, pa.int64())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def layout(cut_pieces: DataFrame, limit: int = LIMIT, grain: int = GRAIN) -> DataFrame:
    """Adds sequence_id and offset to staged pieces."""
    room = limit // grain
    rows = cut_pieces.withColumn("class", F.ceil(F.col("length") / grain).cast("int"))
    total = cut_pieces.count()
    buckets = max(256, -(-total // BUCKET_ROWS))
    # the row's place only has to be spread and fixed: pieces that agree in all of this are interchangeable
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens"), F.lit(buckets)).cast("int"))
    sized = stage(rows.groupBy("class", "bucket").agg(F.count(F.lit(1)).alias("n")), "pack-buckets")
    before = Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets, _ = staged_small(sized.withColumn("skipped", F.coalesce(F.sum("n").over(before), F.lit(0))).select("class", "bucket", "skipped"), "pack-offsets")
    counts = np.zeros(room, np.int64)
    for r in sized.groupBy("class").agg(F.sum("n").alias("n")).collect():  # `room` rows at most
        counts[r["class"] - 1] = r["n"]
    full = int(counts[-1])
    plan = ([(np.eye(1, room, room - 1, dtype=np.int64)[0], full)] if full else []) + patterns(np.append(counts[:-1], 0), room)
    # ranks of a class are dealt to the patterns in turn: (key of class and first rank, first sequence, pieces a sequence, place before it)
    taken, first, deal = np.zeros(room, np.int64), 0, []
    for pattern, times in plan:
        slot = 0
        for c in np.flatnonzero(pattern)[::-1]:
            deal.append(((int(c) + 1 << 44) + int(taken[c]), first, int(pattern[c]), slot))
            taken[c] += pattern[c] * times
            slot += pattern[c]
        first += times
    deal.sort()
    keys, firsts, each, slots = (np.array(x, np.int64) for x in zip(*deal)) if deal else (np.zeros(0, np.int64),) * 4

    @F.pandas_udf("sequence_id long, slot long")
    def place(kind: pd.Series, rank: pd.Series) -> pd.DataFrame:
        key = (kind.to_numpy(np.int64) << 44) + rank.to_numpy(np.int64)
        k = np.searchsorted(keys, key, "right") - 1
        nth = key - keys[k]
        return pd.DataFrame({"sequence_id": firsts[k] + nth // each[k], "slot": slots[k] + nth % each[k]})

    ranked = rows.join(offsets, ["class", "bucket"]).withColumn("rank", F.col("skipped") + F.row_number().over(Window.partitionBy("class", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")) - 1)
    placed = ranked.withColumn("p", place("class", "rank")).withColumns({"sequence_id": F.col("p.sequence_id"), "slot": F.col("p.slot")})
    inside = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # at most LIMIT rows
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(docs: DataFrame, path: str, limit: int = LIMIT, grain: int = GRAIN, end: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    with arrow_rows(docs.sparkSession, ROWS):
        cut_pieces = stage(cut(docs, path, limit, end), "pack-pieces")
    return layout(cut_pieces, limit, grain)


def sequences(docs: DataFrame, packed: DataFrame, path: str, limit: int = LIMIT, end: int = END, pad: int = 0) -> DataFrame:
    """The token ids of every sequence: sequence_id, ids (padded to `limit`, or to nothing if they are as many as a power of two).

    Rows that repeat a doc_id need `packed` made from the same rows; documents are matched by doc_id and the checksum of the piece.
    """

    def run(batches):
        words = pieces(path, blanks=False, memory=MEMORY)
        for batch in small_batches(batches, step=STEP):
            ids, counts = words.encode(batch.column(1))
            ends = np.cumsum(counts)
            for k, stop in enumerate(ends.tolist()):
                own = np.append(ids[stop - int(counts[k]):stop], np.uint32(end)).astype("<u4")
                cuts = range(0, len(own), limit)
                yield pa.record_batch([batch.column(0).take(pa.array([k] * len(cuts), pa.int64())), pa.array(list(cuts), pa.int64()), pa.array([zlib.crc32(own[s:s + limit]) for s in cuts], pa.int64()), pa.array([own[s:s + limit].tolist() for s in cuts], pa.list_(pa.int32()))], ["d", "s", "c", "ids"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "d long, s long, c long, ids array<int>").dropDuplicates(["d", "s", "c"])
    parts = packed.join(texts, packed["doc_id"].eqNullSafe(F.col("d")) & (F.col("start") == F.col("s")) & (F.col("ids_crc32") == F.col("c")))
    joined = parts.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
    size = F.size("ids")
    power = F.expr("size(ids) & (size(ids) - 1)") == 0
    return joined.select("sequence_id", F.when(power, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad), F.lit(limit) - size))).alias("ids"))


def stage_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs.select("doc_id", "text"), vocabulary("word_bpe_49k.json"))


@query("op8_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("word_bpe_49k.json"))
