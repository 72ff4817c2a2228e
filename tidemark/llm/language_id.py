"""Language ID: a byte convolutional network trained in numpy.

Bytes are embedded, filters of several widths slide over fixed-length windows, each filter keeps its maximum, and a softmax layer gives the
language. A text is cut into windows that together cover all of it; its prediction is the mean of their log probabilities, weighted by length.

Training text is a bounded sample (`SAMPLE` documents, `WINDOWS` windows each, spread over the whole text), drawn so that every language gets
about as many documents. Only the drawn windows reach the driver: at most SAMPLE * WINDOWS * WINDOW characters. Prediction reads every byte.

Defined cases: text that is null or has no letter gets `und` with score 0; a null doc_id is never held out; null lang is not learned from;
without any labelled text every prediction is `und`; repeated rows are predicted one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import query, table

#: Documents that training draws, windows of each, and bytes of a window.
SAMPLE, WINDOWS, WINDOW = 4000, 4, 192
WIDTHS, FILTERS, DIMS = (2, 3, 4, 5), 8, 8
EPOCHS, BATCH, RATE = 6, 128, 0.004
#: The pipeline rejects texts without letters and those whose best language scores less than this many times an even share of the learnt languages.
FLOOR = 1.2
_SPAN = max(WIDTHS)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


class ByteNet:
    """embed[byte] -> filters of WIDTHS (as one matrix over the widest span, zero where a narrow filter ends) -> max -> softmax."""

    def __init__(self, labels: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.labels, n = labels, FILTERS * len(WIDTHS)
        mask = np.zeros((_SPAN, DIMS, n), np.float32)
        for k, width in enumerate(WIDTHS):
            mask[:width, :, k * FILTERS:(k + 1) * FILTERS] = 1
        self.mask = mask.reshape(_SPAN * DIMS, n)
        self.p = {"embed": rng.normal(0, 0.5, (257, DIMS)), "filters": rng.normal(0, 0.25, self.mask.shape) * self.mask, "bias": np.zeros(n), "out": rng.normal(0, 0.3, (n, len(labels))), "out_bias": np.zeros(len(labels))}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.p["embed"][256] = 0

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """(n, WINDOW) symbols, 256 is padding -> (n, positions, _SPAN * DIMS); the last positions run over the end into padding."""
        padded = np.concatenate([windows, np.full((len(windows), _SPAN - 1), 256, windows.dtype)], axis=1)
        x = self.p["embed"][padded]
        n, length, _ = x.shape
        s = x.strides
        return np.lib.stride_tricks.as_strided(x, (n, length - _SPAN + 1, _SPAN * DIMS), (s[0], s[1], s[2])).reshape(-1, _SPAN * DIMS)

    def forward(self, windows: np.ndarray):
        cols = self.columns(windows)
        z = (cols @ self.p["filters"]).reshape(len(windows), -1, self.p["bias"].size)
        top = z.max(axis=1) + self.p["bias"]
        hidden = np.maximum(top, 0)
        logits = hidden @ self.p["out"] + self.p["out_bias"]
        logits -= logits.max(axis=1, keepdims=True)
        return cols, z, top, hidden, logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))

    def log_probabilities(self, windows: np.ndarray, chunk: int = 256) -> np.ndarray:
        return np.concatenate([self.forward(windows[i:i + chunk])[4] for i in range(0, len(windows), chunk)]) if len(windows) else np.zeros((0, len(self.labels)), np.float32)

    def gradients(self, windows: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        cols, z, top, hidden, logp = self.forward(windows)
        n, f = hidden.shape
        off = np.exp(logp)
        off[np.arange(n), y] -= 1
        off /= n
        back = (off @ self.p["out"].T) * (top > 0)
        at = z.argmax(axis=1)  # only the maximum of a filter gets a gradient
        seen = cols.reshape(n, -1, cols.shape[1])[np.arange(n)[:, None], at]  # n, f, span * dims
        embed = np.zeros_like(self.p["embed"])
        symbols = np.concatenate([windows, np.full((n, _SPAN - 1), 256, windows.dtype)], axis=1)[np.arange(n)[:, None, None], at[:, :, None] + np.arange(_SPAN)]
        np.add.at(embed, symbols.reshape(-1), (back[:, :, None] * self.p["filters"].T).reshape(-1, DIMS))
        embed[256] = 0
        return {"embed": embed, "filters": np.einsum("nf,nfd->df", back, seen, optimize=True) * self.mask, "bias": back.sum(axis=0), "out": hidden.T @ off, "out_bias": off.sum(axis=0)}

    def fit(self, windows: np.ndarray, y: np.ndarray, seed: int = 6) -> "ByteNet":
        """Adam over shuffled batches."""
        rng, t = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for epoch in range(EPOCHS):
            order = rng.permutation(len(y))
            for i in range(0, len(y), BATCH):
                pick, t = order[i:i + BATCH], t + 1
                for k, g in self.gradients(windows[pick], y[pick]).items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.01 * (g * g - v[k])
                    self.p[k] -= (RATE * (1 - epoch / EPOCHS)) * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.99 ** t)) + 1e-8)
        return self


def cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that cover data[start:end] of each text: symbols (n, size) padded with 256, text of each window, bytes in it. A text shares its windows evenly."""
    length = ends - starts
    n = np.maximum(1, -(-length // size))
    owner = np.repeat(np.arange(len(starts)), n)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    a = starts[owner] + k * length[owner] // n[owner]
    # a window reaches over its end far enough that no n-gram between two windows is lost
    b = np.minimum(starts[owner] + (k + 1) * length[owner] // n[owner] + _SPAN - 1, ends[owner])
    at = a[:, None] + np.arange(size)
    inside = at < np.minimum(b, a + size)[:, None]
    symbols = np.full(at.shape, 256, np.int16)
    symbols[inside] = _FOLD[data[at[inside]]]
    return symbols, owner, np.maximum(1, b - a)


def sample(docs: DataFrame) -> DataFrame:
    """At most SAMPLE labelled rows (lang, windows), about equally many of each language: those of the least digest times the language's count."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    spread = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))) * F.col("n")
    ids = labelled.select("doc_id", "lang").join(counts, "lang").select("doc_id", spread.alias("rank")).orderBy("rank", "doc_id").limit(SAMPLE)
    rows = labelled.join(F.broadcast(ids.select("doc_id").distinct()), "doc_id", "left_semi").where(has_letter(F.col("text")))  # SAMPLE ids at most
    length = F.length("text")
    places = [F.substring(F.col("text"), (F.greatest(length - WINDOW, F.lit(0)) * i / max(1, WINDOWS - 1)).cast("int") + 1, F.lit(WINDOW)) for i in range(WINDOWS)]
    return rows.select("lang", F.array_distinct(F.array(*places)).alias("windows"))


def train(docs: DataFrame) -> ByteNet | None:
    """A network for the languages of `docs` (doc_id, text, lang), or None without labelled text."""
    rows = sample(docs).limit(SAMPLE).toArrow().to_pylist()
    texts = sorted((r["lang"], w) for r in rows for w in r["windows"])
    labels = sorted({lang for lang, _ in texts})
    if not labels:
        return None
    data = [w.encode()[:WINDOW] for _, w in texts]
    ends = np.cumsum([len(d) for d in data])
    symbols, owner, _ = cut(np.frombuffer(b"".join(data), np.uint8), ends - [len(d) for d in data], ends)
    place = {lang: i for i, lang in enumerate(labels)}
    return ByteNet(labels).fit(symbols, np.array([place[lang] for lang, _ in texts])[owner])


def predictor(net: ByteNet | None):
    """Arrow UDF text -> struct(lang, score) of non-null texts; a null text or no network gives null."""
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("lang string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        if net is None:
            return pa.nulls(len(texts), kind)
        langs, scores = np.full(len(texts), None, object), np.zeros(len(texts))
        texts = texts.cast(pa.large_string())
        _, offsets, values = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
        data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
        todo = np.flatnonzero(np.asarray(texts.is_valid()))
        sizes, i = (offsets[todo + 1] - offsets[todo]), 0
        while i < len(todo):
            # a few MB of bytes at a time; a longer text is a piece of its own
            j = max(i + 1, int(np.searchsorted(np.cumsum(sizes[i:]), 1 << 21)) + i)
            part = todo[i:j]
            logp = _texts(net, data, offsets[part], offsets[part + 1])
            best = logp.argmax(axis=1)
            langs[part], scores[part], i = np.array(net.labels, object)[best], np.exp(logp[np.arange(len(part)), best]), j
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.clip(scores, 0, 1))], ["lang", "score"])

    return predict


def _texts(net: ByteNet, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Log probabilities of each text from its windows, taken some thousand at a time."""
    total, weight = np.zeros((len(starts), len(net.labels))), np.zeros(len(starts))
    step = 1 << 18
    for k, (a, b) in enumerate(zip(starts, ends)) if (ends - starts).max(initial=0) > step else ():
        for s in range(a, max(b, a + 1), step):  # very long texts in stretches
            symbols, owner, n = cut(data, np.array([s]), np.array([min(b, s + step)]))
            total[k] += (net.log_probabilities(symbols) * n[:, None]).sum(axis=0)
            weight[k] += n.sum()
    rest = np.flatnonzero(weight == 0)
    bounds = np.append(np.flatnonzero(np.diff(np.cumsum(np.maximum(1, ends[rest] - starts[rest])) // step, prepend=-1)), len(rest))
    for i, j in zip(bounds, bounds[1:]):
        part = rest[i:j]
        symbols, owner, n = cut(data, starts[part], ends[part])
        logp = net.log_probabilities(symbols) * n[:, None]
        np.add.at(total, part[owner], logp)
        np.add.at(weight, part[owner], n)
    mean = total / weight[:, None]
    mean -= mean.max(axis=1, keepdims=True)
    return mean - np.log(np.exp(mean).sum(axis=1, keepdims=True))


def identify(docs: DataFrame, net: ByteNet | None = None) -> DataFrame:
    """`docs` (doc_id, text, lang, more) with lang_pred and score added, by `net` or by one trained on them."""
    guess = predictor(net or train(docs))
    lettered = has_letter(F.col("text"))
    found = docs.withColumn("__p", guess(F.when(lettered, F.col("text"))))
    return found.withColumns({"lang_pred": F.coalesce("__p.lang", F.lit("und")), "score": F.coalesce("__p.score", F.lit(0.0))}).drop("__p")


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: texts without letters go, and those whose best score is under FLOOR times an even share.

    Without labelled text nothing can be told apart: then only texts without letters go.
    """
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text", "lang")
    net = train(inner)
    if net is None:
        return inner.where(has_letter(F.col("text"))).select("row.*")
    return identify(inner, net).where((F.col("lang_pred") != "und") & (F.col("score") >= FLOOR / len(net.labels))).select("row.*")


@query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
