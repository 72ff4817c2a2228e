"""Findings of round 4: what failed before, on small inputs."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import wording as wd


def shuffled(spark) -> int:
    """Bytes that the session has written to shuffles so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))


def test_long_filings_are_not_shuffled_once_for_each_block_of_the_other(spark, tmp_path):
    """statements of a long document moved as often as its neighbour has blocks of 64."""
    from tidemark.plans.documents import novelty_best
    r = random.Random(2)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(3000)]
    texts = [" ".join(f"{r.choice(words)} {r.choice(words)}." for _ in range(1200)) for _ in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"source": F.lit("s"), "lang": F.lit("en")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    before = shuffled(spark)
    assert novelty_best(spark, str(tmp_path)).count() == 11 * 1200
    assert shuffled(spark) - before < 4 * sum(map(len, texts))


def test_strips_of_filings_give_what_rows_of_statements_give(spark):
    """headings, equal statements, statements longer than a strip, filings that are null, blank, alone or prior to several."""
    r = random.Random(4)
    say = lambda: "".join(r.choices("ab \té", k=r.randint(1, 12))) + r.choice([".", "!", "\n", "\n\n  ", ". ", " Item 2.02 x.\n", "\\n. "])
    texts = ["".join(say() for _ in range(r.randint(0, 40))) for _ in range(14)] + [None, "", " \n ", "a" * 300 + ". b.", texts_twice := "ab. ab. é a.\nab. ", texts_twice]
    filings = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs = spark.createDataFrame([(k, k - 1) for k in range(1, len(texts))] + [(0, 5), (0, 6)], "doc_id long, prior_id long")
    each = F.transform(tx.statement_array(F.col("text")), lambda x, i: F.struct(i.alias("pos"), F.regexp_replace(x["quoted_text"], wd.SPACES, " ").alias("text"), x["sec_item"].alias("item")))
    rows = filings.select("doc_id", F.inline(each))
    keys = ["doc_id", "prior_id"]
    want = sorted(map(tuple, wd.best_prior(pairs.join(rows, "doc_id"), pairs.join(rows.withColumnRenamed("doc_id", "prior_id"), "prior_id"), keys).collect()), key=str)
    assert len(want) > 200 and {x[4] for x in want} == {"unchanged", "changed", "new_statement"}
    for strip in (25, wd.STRIP):
        assert sorted(map(tuple, wd.best_prior_filing(filings, pairs, tx.statement_array(F.col("text")), strip).collect()), key=str) == want


def test_token_files_tokenize_what_an_earlier_run_has_seen(spark, monkeypatch):
    """a worker kept its pieces from one query to the next, so a second run over the same documents tokenized nothing."""
    from tidemark.llm import token_files, tokens

    class Docs:
        """Keeps what a task of the written frame runs."""

        def __getattr__(self, name):
            return self if name == "write" else lambda *_: self

        def mapInArrow(self, run, schema):
            runs.append(run)
            return self

    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 0)

    runs, asked, learn = [], [], tokens.Pieces._learn
    monkeypatch.setattr(tokens, "_known", {})
    monkeypatch.setattr(tokens.Pieces, "_learn", lambda self, new: (asked.append(list(new)), learn(self, new))[1])
    monkeypatch.setattr(token_files, "TaskContext", Task)
    batch = pa.record_batch([pa.array([1, 2]), pa.array(["one two, three", "two four"])], ["doc_id", "text"])
    for _ in range(2):
        token_files.write(Docs(), "", tokens.vocabulary("byte_bpe_50k.json"))
    per_run = []
    for run in runs:
        for _ in range(2):  # two tasks of a run on one worker
            asked.clear()
            coded = [b.column("coded")[0].as_py() for b in run([batch])]
            per_run.append((sorted(p for some in asked for p in some), coded))
    (first, a), (again, b), (second, c), _ = per_run
    assert first == second == sorted(["one", "two", " two,", " three", " four"]) and again == [] and a == b == c
