"""Alignment of two tokenizers' tokens by merge-path partitioning.

A is a byte-level vocabulary over blank + text, B a piece vocabulary over the text, which adds the blank itself. Where both give back the bytes of
blank + text, the ends of their tokens are two sorted lists of byte offsets. `merge_path` merges them: binary searches on evenly spaced diagonals
cut the merge into pieces of equal work, which proceed side by side, each over its own stretch of both lists. A step emits a link: an A token and a
B token whose bytes overlap. A piece that begins between the two halves of a shared end knows it from the token before it and emits nothing for the
second half; groups that span pieces are joined by numbering the shared ends through all pieces.

Two passes meet in `counted`. Blocks of documents (BLOCK bytes, or one longer text) are aligned once and written with the id pairs they hold, each
pair once with its count. Pairs are summed over the corpus, compared with the best of their B id (at most one row an id of the vocabulary), and
sent back to the blocks that hold them. A frequent pair is one row a block, so no key is hot; texts do not move.

Both vocabularies treat blank + word by itself wherever a blank stands between visible characters, and what begins with a line feed behind one, so
a block tokenizes each distinct word once; texts with other white space around a blank, a blank at an end, a line feed at the start or a literal
U+2581 go through the tokenizers whole.

Defined cases: a null or empty text, or one whose bytes a tokenizer changes, has no tokens: zeros and an empty `groups_sha256`; repeated rows, also of
one doc_id, are aligned and counted one by one; a null doc_id stays null; a very long text is a block of its own; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import query, release, sliced, table
from tidemark.llm.tokens import _AWKWARD, _LINE, Pieces, vocabulary
from tidemark.staging import stage

#: Bytes of text in a block; steps of a piece of the merge.
BLOCK, WORK = 1 << 20, 64
#: Distinct words, and their bytes, that a worker remembers.
MEMORY, MEMORY_BYTES = 100_000, 1 << 23
_WHOLE = _AWKWARD + r"|^[ \n]| $|\x{2581}"
#: Before a whole text among the words; no word holds it.
_MARK = "▁"


def merge_path(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (i, j) of two sorted lists of ends with the same last end, in order, and whether a group ends with the link.

    Token i of A and token j of B overlap. Equal ends count as A's first.
    """
    na, nb = len(a), len(b)
    if na == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    diagonal = np.arange(0, na + nb, work)
    low, high = np.maximum(0, diagonal - nb), np.minimum(diagonal, na)
    while (low < high).any():
        # how many of the first `diagonal` ends are A's: the least i with a[i] > b[diagonal - 1 - i]
        middle = (low + high) // 2
        open_ = low < high
        later = a[np.minimum(middle, na - 1)] > b[np.clip(diagonal - 1 - middle, 0, nb - 1)]
        high = np.where(open_ & later, middle, high)
        low = np.where(open_ & ~later, middle + 1, low)
    i, j = low.copy(), diagonal - low
    stop = np.append(diagonal[1:], na + nb)
    # one value behind either list, greater than all, and one before A's, less than all
    a, b = np.concatenate([[-1], a, [np.iinfo(np.int64).max]]), np.append(b, np.iinfo(np.int64).max)
    left, right, emits, shared = (np.empty((work, len(i)), t) for t in (np.int64, np.int64, bool, bool))
    for k in range(work):
        end_a, end_b = a[i + 1], b[j]
        first = end_a <= end_b
        left[k], right[k], shared[k] = i, j, end_a == end_b
        emits[k] = (first | (a[i] != end_b)) & (i + j < stop)
        i, j = i + first, j + ~first
        done = i + j > stop  # the last piece may be shorter
        i, j = i - (done & first), j - (done & ~first)
    keep = emits.T.ravel()
    return left.T.ravel()[keep], right.T.ravel()[keep], shared.T.ravel()[keep]


class Both:
    """Tokens of words under two vocabularies."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        self.a, self.b = Pieces(path_a, True), SentencePieceProcessor(model_file=path_b)
        self.a.tokenizer.encode_special_tokens = True
        byte = {c: k for k, c in enumerate(_bytes())}
        tokenizer, n = self.a.tokenizer, self.a.tokenizer.get_vocab_size()
        self.bytes_a = [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in map(tokenizer.id_to_token, range(n))]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in ((k, self.b.id_to_piece(k)) for k in range(self.b.get_piece_size()))]
        self.size_a, self.size_b = (np.array([len(x) for x in own], np.int64) for own in (self.bytes_a, self.bytes_b))
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.held, self.fits = 0, np.zeros(0, bool)
        self.pool = {k: (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)) for k in "ab"}  # ids, start, size

    def look_up(self, words: list[str]) -> np.ndarray:
        """Numbers of the words; `pool` and `fits` hold what belongs to them until the next `forget`. A word has a blank before it unless it begins with
        a line feed; a whole text comes with _MARK before it."""
        new = [w for w in dict.fromkeys(words) if w not in self.number]
        for at in range(0, len(new), 20_000):
            part = new[at:at + 20_000]
            full = [w if w[:1] == "\n" else " " + w.removeprefix(_MARK) for w in part]
            pieces = self.b.encode([w.removeprefix(_MARK) for w in part], num_threads=1)
            # the vocabulary's own blank before a line feed is a piece by itself
            ids = {"a": self.a.tokenized(full), "b": [y[1:] if w[:1] == "\n" else y for w, y in zip(part, pieces)]}
            a, b = self.bytes_a, self.bytes_b
            fits = [b"".join([a[k] for k in x]) == (own := w.encode()) == b"".join([b[k] for k in y]) for w, x, y in zip(full, ids["a"], ids["b"])]
            for side, found in ids.items():
                flat, start, size = self.pool[side]
                n = np.fromiter(map(len, found), np.int64, len(found))
                self.pool[side] = (np.append(flat, np.fromiter((k for x in found for k in x), np.int64, int(n.sum()))), np.append(start, len(flat) + np.cumsum(n) - n), np.append(size, n))
            self.fits = np.append(self.fits, fits)
            self.number.update(zip(part, range(len(self.number), len(self.number) + len(part))))
            self.held += sum(map(len, part))
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def encode(self, texts: pa.Array) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        """Ids of all texts one after another and the number of each text's, for both sides."""
        if len(self.number) > MEMORY or self.held > MEMORY_BYTES:
            self.forget()
            release()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = pc.match_substring_regex(texts, _WHOLE).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(pc.replace_substring_regex(pc.if_else(pa.array(whole), "", texts), _LINE, "\\1 \n"), " ")
        bounds = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        numbers = self.look_up(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        at = np.flatnonzero(whole)
        numbers[bounds[at]] = self.look_up([_MARK + texts[int(k)].as_py() for k in at])  # in place of the one empty word
        doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
        bad = np.zeros(len(texts), bool)
        bad[doc[~self.fits[numbers]]] = True
        bad |= pc.equal(texts, "").to_numpy(zero_copy_only=False)
        keep = ~bad[doc]
        numbers, doc = numbers[keep], doc[keep]
        ids, counts = {}, {}
        for side, (flat, start, size) in self.pool.items():
            n = size[numbers]
            ids[side] = flat[np.repeat(start[numbers] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            counts[side] = np.bincount(doc, n, len(texts)).astype(np.int64)
        return ids, counts


def _bytes() -> list[str]:
    """Characters in which a byte-level vocabulary writes the bytes 0 to 255."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(k) if k in shown else chr(next(hidden)) for k in range(256)]


_known: dict[tuple[str, str], Both] = {}


def _lines(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, n: int, doc_a: np.ndarray, doc_b: np.ndarray, decimals: pa.Array) -> list[str]:
    """SHA-256 of each document's groups, written as decimal ids; '' without tokens. doc_a, doc_b: where each document's tokens begin and end."""
    count_a, count_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    before_a, before_b = np.cumsum(count_a), np.cumsum(count_b) - count_b
    last_a, last_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
    which = np.empty(len(a) + len(b), np.int64)
    which[np.arange(len(a)) + before_b[group_a]] = a * 3 + last_a
    which[np.arange(len(b)) + before_a[group_b]] = b * 3 + 2 * last_b
    text = decimals.take(pa.array(which))
    ends = np.frombuffer(text.buffers()[1], np.int64)[:len(which) + 1]
    view = memoryview(text.buffers()[2])
    bounds = ends[doc_a + doc_b].tolist()
    return [hashlib.sha256(view[s:e - 1]).hexdigest() if e > s else "" for s, e in zip(bounds, bounds[1:])]


_BLOCK = ("block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, "
          "links binary, pairs array<long>, counts array<long>")
_ROW = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def aligned(docs: DataFrame, path_a: str, path_b: str, block: int = BLOCK, work: int = WORK) -> DataFrame:
    """One row per block of documents: counts and group digests of each, its links as numbers of the block's distinct id pairs, and those pairs."""

    def run(batches):
        if (path_a, path_b) not in _known:
            _known[path_a, path_b] = Both(path_a, path_b)
        both = _known[path_a, path_b]
        decimals = pa.array([f"{k}{c}" for k in range(max(len(both.bytes_a), len(both.bytes_b))) for c in ",|;"], pa.large_string())
        try:
            for k, batch in enumerate(sliced(batches, block)):
                ids, counts = both.encode(batch.column(1))
                a, b = ids["a"], ids["b"]
                i, j, ends = merge_path(np.cumsum(both.size_a[a]), np.cumsum(both.size_b[b]), work)
                doc_a, doc_b = np.append(0, np.cumsum(counts["a"])), np.append(0, np.cumsum(counts["b"]))
                group = np.cumsum(ends) - ends  # of each link
                group_a, group_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
                group_a[i], group_b[j] = group, group
                bounds = np.searchsorted(i, doc_a)
                pairs, which, n = np.unique(a[i] << 16 | b[j], return_inverse=True, return_counts=True)
                sums = np.append(0, np.cumsum(ends))
                digests = _lines(a, b, group_a, group_b, int(ends.sum()), doc_a, doc_b, decimals)
                one = [TaskContext.get().partitionId() << 32 | k, batch.column(0).to_pylist(), counts["a"], counts["b"], np.diff(sums[bounds]), np.diff(bounds), digests,
                       pa.compress(which.astype("<u4").tobytes(), "zstd", asbytes=True), pairs, n]
                yield pa.record_batch([pa.array([x], t) for x, t in zip(one, [pa.int64(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string()), pa.binary(), *[pa.list_(pa.int64())] * 2])],
                                      names=[x.split()[0] for x in _BLOCK.split(", ")])
        finally:
            both.forget()
            del decimals
            release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _BLOCK)


def counted(blocks: DataFrame) -> DataFrame:
    """One row per document, with the corpus-wide counts of its links' id pairs."""
    held = blocks.select("block", F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select("block", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    total = stage(held.groupBy("pair").agg(F.sum("n").alias("n")), "alignment-pairs")
    best = total.groupBy(F.col("pair").bitwiseAND(0xFFFF).alias("b")).agg(F.max("n").alias("most"))  # a row for each id of B at most
    total = total.withColumn("b", F.col("pair").bitwiseAND(0xFFFF)).join(F.broadcast(best), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    back = held.select("block", "pair").join(total, "pair").groupBy("block").agg(F.collect_list(F.struct("pair", "n", "best")).alias("found"))

    def run(batches):
        for batch in batches:
            columns = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            for k in range(batch.num_rows):
                own = {name: columns[name][k].values for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
                links = own["n_links"].to_numpy()
                n, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if columns["found"][k].is_valid:
                    found = columns["found"][k].values
                    order = np.argsort(found.field("pair").to_numpy())
                    n, best = found.field("n").to_numpy()[order], found.field("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)
                which = np.frombuffer(pa.decompress(columns["links"][k].as_py(), int(links.sum()) * 4, "zstd", asbytes=True), "<u4")
                bounds = np.append(0, np.cumsum(links))
                sums, bests = np.append(0, np.cumsum(n[which])), np.append(0, np.cumsum(best[which]))
                yield pa.record_batch([own["doc_id"], own["n_a"], own["n_b"], own["n_groups"], own["n_links"], pa.array(np.diff(bests[bounds])), pa.array(np.diff(sums[bounds])), own["groups_sha256"]],
                                      names=[x.split()[0] for x in _ROW.split(", ")])

    return blocks.drop("pairs", "counts").join(back, "block", "left").mapInArrow(run, _ROW)


@query("op13_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = aligned(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    return counted(stage(blocks, "alignment-blocks"))
