"""Language-model scoring with a probabilistic suffix tree over bytes that smooths the words' counts, beside a unigram base over words.

Texts are taken as their lower-case words joined by blanks and one end symbol. The tree keeps contexts of 1 to DEPTH bytes that occur at least
MIN_COUNT times, whatever the size of the corpus, and whose next-symbol distribution diverges from their parent's by more than its parameters
cost (count * KL divergence against half the log of the count for each symbol). A kept node's distribution is smoothed towards its nearest kept
ancestor, with as much weight as it has different next symbols. A symbol is scored by the longest kept suffix of what stands before it.

The number of contexts grows with the corpus, so no process holds them all. A symbol's probability depends on its (DEPTH + 1)-gram alone. The
grams of all batches are dealt to shards by the last SPLIT bytes of their context; a shard has all longer contexts with these bytes, decides
which are kept, and gives each batch the probabilities of its grams. The contexts of fewer bytes are decided once, from (SPLIT)-grams' counts.

A word's probability is the mean of its base share and of the tree's probability of its bytes, with the blank or end behind them, after what
precedes them: common words are predicted by their counts, rare ones by how they are spelt. The end of a text has its base share.

The corpus is read once. Each batch becomes its own dictionary of words, its texts as codes, and its (DEPTH + 1)-grams with their counts in
training texts; words are counted over all batches in one shuffle of dictionary rows, never of one row per token, and go back to their batch with
their counts.

Defined cases: a null text is empty and scores its end symbol alone; a null doc_id counts as training text; rows that repeat a doc_id are separate
documents; bytes never seen in training share the root's smoothing; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import release, query, table
from tidemark.staging import stage

#: Bytes of the longest context; least count of a context; last bytes of a context by which it is dealt to a shard.
DEPTH, MIN_COUNT, SPLIT = 6, 2, 3
#: Symbols that one step of the automaton's lanes covers, and bytes taken at a time.
STRETCH, STEP = 256, 1 << 20
END = 10
LN10 = float(np.log(10))
_ROWS = "kind int, batch long, code int, word string, n long, doc_ids array<long>, words array<int>, held array<boolean>, codes binary, counts binary"


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


class Words:
    """Texts as codes of a dictionary of words."""

    def __init__(self, words: list[bytes] | pa.Array):
        words = words if isinstance(words, pa.Array) else pa.array(words, pa.large_binary())
        data = pc.binary_join_element_wise(words.cast(pa.large_binary()), pa.scalar(b" ", pa.large_binary()), pa.scalar(b"", pa.large_binary()))
        offsets = np.frombuffer(data.buffers()[1], np.int64, len(data) + 1, data.offset * 8)
        raw = np.frombuffer(data.buffers()[2], np.uint8) if len(data) else np.zeros(0, np.uint8)
        self.data = np.concatenate([raw[offsets[0]:offsets[-1]] if len(data) else raw, np.full(DEPTH, END, np.uint8)])
        starts = offsets - offsets[0]
        # the last entry is what ends a text: its end symbol, and the rest of a context of end symbols for the next text
        self.start, self.size = starts.astype(np.int64), np.append(np.diff(starts), DEPTH).astype(np.int64)

    def stream(self, codes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of texts with `words` words each: a context of end symbols, then w w ... w END and DEPTH - 1 more of it each. And where each text begins."""
        ends = np.cumsum(words)
        tokens = np.insert(codes.astype(np.int64), ends, len(self.size) - 1)
        size = self.size[tokens]
        last = np.cumsum(words + 1) - 2
        size[last[words > 0]] -= 1  # no blank before the end
        after = np.cumsum(size)
        at = np.repeat(self.start[tokens] - (after - size), size)
        at += np.arange(len(at))
        stops = after[np.cumsum(words + 1) - 1] if len(words) else np.zeros(0, np.int64)
        return np.concatenate([np.full(DEPTH, END, np.uint8), self.data[at]]), DEPTH + np.append(0, stops)


def _portions(words: np.ndarray, size: np.ndarray):
    """Ranges of texts of about STEP bytes in all."""
    ends = np.cumsum(size)
    i = 0
    while i < len(words):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + STEP, "right")))
        yield i, j
        i = j


def _texts(codes: np.ndarray, words: np.ndarray, dictionary: Words):
    """(range of texts, stream, beginnings) portion by portion."""
    bounds = np.append(0, np.cumsum(words))
    weight = np.append(0, np.cumsum(dictionary.size[codes]))[bounds]
    for i, j in _portions(words, weight[1:] - weight[:-1] + DEPTH):
        stream, begin = dictionary.stream(codes[bounds[i]:bounds[j]], words[i:j])
        yield i, j, stream, begin


def _packed(stream: np.ndarray) -> np.ndarray:
    """The (DEPTH + 1)-gram that ends at each byte after the first DEPTH."""
    packed = np.zeros(len(stream) - DEPTH, np.int64)
    for k in range(DEPTH + 1):
        packed <<= 8
        packed |= stream[k:len(stream) - DEPTH + k]
    return packed


def _scored(begin: np.ndarray, size: int) -> np.ndarray:
    """Which bytes belong to texts or are their end symbols, not the rest of a context of end symbols."""
    keep = np.ones(size, bool)
    for k in range(1, DEPTH):
        keep[begin[1:] - DEPTH - k] = False
    return keep


def _grams(stream: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(DEPTH + 1)-grams that end at each byte of the texts and at their end symbols, with counts."""
    packed = _packed(stream)
    return np.unique(packed[_scored(begin, len(packed))], return_counts=True)


def _squeeze(numbers: np.ndarray) -> bytes:
    """Non-negative numbers byte plane by byte plane."""
    return zlib.compress(np.ascontiguousarray(numbers.astype(">i8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unsqueeze(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T).view(">i8").reshape(-1).astype(np.int64)


def survey(docs: DataFrame) -> DataFrame:
    """One staged table of four kinds of rows: 0 texts of a batch as codes, 1 words of a batch with their count in training texts, 2 grams of a batch in a
    shard with their count in training texts (0 for grams of held-out texts only), 3 their last SPLIT bytes, counted likewise."""
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        batch_id = TaskContext.get().partitionId() << 24
        empty = {"kind": pa.int32(), "batch": pa.int64(), "code": pa.int32(), "word": pa.string(), "n": pa.int64(), "doc_ids": pa.list_(pa.int64()), "words": pa.list_(pa.int32()), "held": pa.list_(pa.bool_()), "codes": pa.binary(), "counts": pa.binary()}

        def rows(size: int, /, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({k: columns.get(k, pa.nulls(size, kind)) for k, kind in empty.items()})

        for batch in batches:
            batch_id += 1
            ids = batch.column(0).to_pylist()
            split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(batch.column(1).cast(pa.large_string()), "")))
            flat, offsets = split.flatten(), split.offsets.to_numpy().astype(np.int64)
            full = pc.greater(pc.binary_length(flat), 0)
            words = np.diff(np.append(0, np.cumsum(full.to_numpy(zero_copy_only=False)))[offsets - offsets[0]])
            coded = flat.filter(full).dictionary_encode()
            codes = coded.indices.to_numpy().astype(np.int32)
            del batch, split, flat, full, offsets
            release()
            held = np.array([held_out(i) for i in ids], bool)
            train = np.repeat(~held, words)
            count = np.bincount(codes[train], minlength=len(coded.dictionary))
            n = len(count)
            yield rows(1, kind=pa.array([0], pa.int32()), batch=pa.array([batch_id], pa.int64()), doc_ids=pa.array([ids], pa.list_(pa.int64())), words=pa.array([words.astype(np.int32)], pa.list_(pa.int32())), held=pa.array([held], pa.list_(pa.bool_())),
                       codes=pa.array([zlib.compress(codes.tobytes(), 1)], pa.binary()))
            if n:
                yield rows(n, kind=pa.array(np.full(n, 1, np.int32)), batch=pa.array(np.full(n, batch_id, np.int64)), code=pa.array(np.arange(n, dtype=np.int32)), word=coded.dictionary.cast(pa.string()), n=pa.array(count.astype(np.int64)))
            dictionary, seen = Words(coded.dictionary.cast(pa.large_binary())), []
            del coded
            for of, some, times in ((train, ~held, 1), (~train, held, 0)):
                for _, _, stream, begin in _texts(codes[of], words[some], dictionary):
                    grams, counts = _grams(stream, begin)
                    seen.append((grams, counts * times))
                    if len(seen) > 3:
                        seen = [_merge(seen)]
            if seen:
                grams, counts = _merge(seen)
                seen.clear()
                ends, ended = _merge([(grams & ((1 << 8 * SPLIT) - 1), counts)])
                yield rows(len(ends), kind=pa.array(np.full(len(ends), 3, np.int32)), code=pa.array(ends.astype(np.int32)), n=pa.array(ended.astype(np.int64)))
                shard = ((grams >> 8 & ((1 << 8 * SPLIT) - 1)) * 2654435761 >> 16) % shards
                order = np.argsort(shard, kind="stable")
                found, first = np.unique(shard[order], return_index=True)
                parts = np.split(order, first[1:])
                yield rows(len(found), kind=pa.array(np.full(len(found), 2, np.int32)), batch=pa.array(np.full(len(found), batch_id, np.int64)), code=pa.array(found.astype(np.int32)),
                           codes=pa.array([_squeeze(grams[x]) for x in parts], pa.binary()), counts=pa.array([_squeeze(counts[x]) for x in parts], pa.binary()))

    return stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_released(run), _ROWS), "suffix-survey")


def _merge(parts) -> tuple[np.ndarray, np.ndarray]:
    grams, counts = np.concatenate([g for g, _ in parts]), np.concatenate([c for _, c in parts]).astype(np.int32)
    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order]
    first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else np.zeros(0, np.int64)
    return grams[first], np.add.reduceat(counts, first) if len(first) else counts


def _released(task):
    """Its rows; at the end, memory that the worker would keep while it is idle goes back to the system."""
    def run(*args):
        try:
            yield from task(*args)
        finally:
            release()
    return run


def deepen(grams: np.ndarray, n: np.ndarray, lengths: range, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(p, q) of each gram's last symbol after contexts of up to max(lengths) bytes: by the longest kept context, and the share of the longest one itself.

    `p` and `q` are the same after contexts one byte shorter than `lengths`. `grams` are distinct and have all counts of the contexts of `lengths`.
    """
    for d in lengths:
        _, first, back = np.unique(grams & ((1 << 8 * (d + 1)) - 1), return_index=True, return_inverse=True)
        count = np.bincount(back, n, len(first))
        _, of = np.unique(grams[first] >> 8 & ((1 << 8 * d) - 1), return_inverse=True)
        total, symbols = np.bincount(of, count), np.bincount(of, count > 0)
        share = count / np.maximum(total, 1)[of]
        gain = np.bincount(of, count * np.log(np.divide(share, q[first], out=np.ones(len(first)), where=count > 0)))
        kept = (total >= MIN_COUNT) & (gain > 0.5 * symbols * np.log(np.maximum(total, 1)))
        p = np.where(kept[of], (count + symbols[of] * p[first]) / np.maximum(total + symbols, 1)[of], p[first])[back]
        q = share[back]
    return p, q


def short(ends: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted SPLIT-grams with their (p, q) after contexts of up to SPLIT - 1 bytes."""
    order = np.argsort(ends)
    ends, n = ends[order], n[order]
    symbol = np.bincount(ends & 255, n, 256)
    p, q = (symbol + 0.5) / (symbol.sum() + 128), symbol / max(symbol.sum(), 1)
    return ends, *deepen(ends, n, range(1, SPLIT), p[ends & 255], q[ends & 255])


def long(grams: np.ndarray, n: np.ndarray, shorter: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Probabilities of all grams of a shard."""
    at = np.searchsorted(shorter[0], grams & ((1 << 8 * SPLIT) - 1))
    return deepen(grams, n, range(SPLIT, DEPTH + 1), shorter[1][at], shorter[2][at])[0]


def probabilities(survey_rows: DataFrame) -> DataFrame:
    """(batch, grams, logs): the grams of a batch in a shard and their log10 probabilities."""
    ends = survey_rows.where("kind = 3").groupBy("code").agg(F.sum("n").alias("n")).toArrow()  # at most 256 ** SPLIT rows, some ten thousand in texts
    shorter = survey_rows.sparkSession.sparkContext.broadcast(short(ends["code"].to_numpy().astype(np.int64), ends["n"].to_numpy()))

    def run(shard: pa.Table) -> pa.Table:
        parts = [_unsqueeze(x.as_py()) for x in shard["codes"]]
        grams, back = np.unique(np.concatenate(parts), return_inverse=True)
        n = np.bincount(back, np.concatenate([_unsqueeze(x.as_py()) for x in shard["counts"]]), len(grams))
        logs = np.log10(long(grams, n, shorter.value)).astype(np.float32)[back]
        del grams, back, n
        release()
        return pa.table({"batch": shard["batch"], "grams": shard["codes"], "logs": pa.array([zlib.compress(x.tobytes(), 1) for x in np.split(logs, np.cumsum([len(x) for x in parts])[:-1])], pa.binary())})

    return survey_rows.where("kind = 2").select("batch", "code", "codes", "counts").groupBy("code").applyInArrow(run, "batch long, grams binary, logs binary")


def score(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = survey(docs)
    texts = rows.where("kind = 0").select("batch", "doc_ids", "words", "held", "codes")
    by_word = Window.partitionBy("word")
    words = rows.where("kind = 1").select("batch", "code", "word", "n").withColumns({"total": F.sum("n").over(by_word), "nth": F.row_number().over(by_word.orderBy("batch"))})
    words = stage(words.select("batch", "code", "word", "total", (F.col("nth") == 1).alias("once")), "suffix-words")
    sums = texts.select(F.sum(F.aggregate(F.arrays_zip("words", "held"), F.lit(0).cast("long"), lambda s, x: s + F.when(x["held"], 0).otherwise(x["words"] + 1))).alias("tokens"), F.sum(F.size(F.filter("held", lambda h: ~h))).alias("docs")).first()
    end_count, all_tokens = int(sums["docs"] or 0), int(sums["tokens"] or 0)
    distinct = words.where("once and total > 0").count() + (end_count > 0)
    divisor = np.log10(all_tokens + 0.5 * (distinct + 1))

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        spelt_in, right = right.filter(pc.is_valid(right["grams"])), right.filter(pc.is_null(right["grams"]))
        order = np.argsort(right["code"].to_numpy(), kind="stable")
        total = right["total"].to_numpy()[order]
        grams = np.concatenate([np.zeros(0, np.int64), *(_unsqueeze(x.as_py()) for x in spelt_in["grams"])])
        logs = np.concatenate([np.zeros(0, np.float32), *(np.frombuffer(zlib.decompress(x.as_py()), np.float32) for x in spelt_in["logs"])])
        by_gram = np.argsort(grams)
        grams, logs = grams[by_gram], logs[by_gram]
        del spelt_in, by_gram
        release()
        dictionary = Words(right["word"].combine_chunks().cast(pa.large_binary()).take(pa.array(order)))
        worth = np.log10(total + 0.5) - divisor
        end_worth = np.log10(end_count + 0.5) - divisor
        codes = np.frombuffer(zlib.decompress(left["codes"][0].as_py()), np.int32)
        n = left["words"][0].values.to_numpy().astype(np.int64)
        bounds = np.append(0, np.cumsum(n))
        cut = lambda x: np.diff(np.append(0, np.cumsum(x))[bounds])
        base = np.array([worth[codes[a:b]].sum() for a, b in zip(bounds, bounds[1:])]) + end_worth
        own = np.zeros(len(n))
        for i, j, stream, begin in _texts(codes, n, dictionary):
            packed = _packed(stream)
            packed, back = np.unique(packed[_scored(begin, len(packed))], return_inverse=True)
            value = logs[np.searchsorted(grams, packed)][back]
            some, empty = codes[bounds[i]:bounds[j]], np.flatnonzero(n[i:j] == 0)
            # bytes of a word and what ends it; a text without words has only its end
            size = np.insert(dictionary.size[some], bounds[i + empty] - bounds[i], 1)
            spelt = np.add.reduceat(value.astype(np.float64), np.cumsum(size) - size)
            word = np.delete(spelt, bounds[i + empty] - bounds[i] + np.arange(len(empty)))
            own[i:j] = np.diff(np.append(0, np.cumsum((np.logaddexp(worth[some] * LN10, word * LN10) - np.log(2)) / LN10))[bounds[i:j + 1] - bounds[i]]) + end_worth
        del grams, logs, dictionary
        release()
        return pa.table({"doc_id": left["doc_ids"][0].values, "held_out": left["held"][0].values, "n_tokens": pa.array(n + 1), "n_known": pa.array(cut(total[codes] > 0).astype(np.int64) + (end_count > 0)),
                         "train_tokens": pa.array(np.full(len(n), all_tokens, np.int64)), "base_score": pa.array(base), "score": pa.array(own)})

    right = words.select("batch", "code", "word", "total").unionByName(probabilities(rows), allowMissingColumns=True)
    return texts.groupBy("batch").cogroup(right.groupBy("batch")).applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


@query("op7_suffix_tree")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))
