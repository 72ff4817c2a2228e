"""Memory of tokenizing in packing, and pieces that are put together from parts."""

import random
import tracemalloc

import pyarrow as pa
from tokenizers import Tokenizer

from tidemark.llm import packing, tokens


def test_packing_tokenizes_little_at_a_time():
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(2000)]
    texts = [" ".join(r.choice(words) for _ in range(300)) for _ in range(2300)]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    words = tokens.Pieces(tokens.vocabulary("word_bpe_49k.json"), blanks=False)
    tracemalloc.start()
    try:
        for some in tokens.small_batches([batch], step=getattr(packing, "STEP", tokens.STEP)):
            words.encode(some.column(1))
        assert tracemalloc.get_traced_memory()[1] < 40e6
    finally:
        tracemalloc.stop()


def test_marks_and_line_feeds_do_not_ask_for_a_word_again():
    class Counted:
        def __init__(self, model):
            self.model, self.asked = model, []

        def tokenize(self, text):
            self.asked.append(text)
            return self.model.tokenize(text)

    texts = ["so Wort Wort, Wort. Wort### Wort.$$$\nWort!! naïve naïve,*** it's it've. <|endoftext|>, a_b_ __ Wort'. é%%%\n\nWort"] * 2
    texts += ["".join(random.Random(i).choices(["Wort", "é", " ", "  ", "\n", ".", ",###", "'", "'s", "_", "12", "日", "\r", "<|", "|>", "<|endoftext|>", "MIXed"], k=20)) for i in range(2000)]
    for name, blanks in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        path = tokens.vocabulary(name)
        own = tokens.Pieces(path, blanks)
        own.model = counted = Counted(own.model)
        ids, counts = own.encode(pa.array(texts))
        want = [e.ids for e in Tokenizer.from_file(path).encode_batch_fast(texts, add_special_tokens=False)]
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
        assert len(counted.asked) == len(set(counted.asked))


def test_a_word_learnt_as_a_part_is_not_learnt_again():
    words = [f" {a}{b}{c}{d}" for a in "abcdefghijklm" for b in "abcdefghijklm" for c in "abcdefghijklm" for d in "abcdefghijk"]
    path = tokens.vocabulary("byte_bpe_50k.json")
    text = "x" + ",".join(words) + ";" + "".join(words)
    ids, _ = tokens.Pieces(path, True).encode(pa.array([text]))
    assert ids.tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_alignment_gets_the_ids_of_words_and_keeps_no_second_memory():
    from tidemark.llm import token_alignment
    a, b = tokens.vocabulary("byte_bpe_50k.json"), tokens.vocabulary("piece_bpe_32k.model")
    both = token_alignment.Both(a, b)
    text = "so Wort Wort, naïve,***\nWort!! it's <|endoftext|> 日本"
    ids, counts = both.encode(pa.array([text, "", text]))
    plain = Tokenizer.from_file(a)
    plain.encode_special_tokens = True
    want = plain.encode(" " + text, add_special_tokens=False).ids
    assert ids["a"].tolist() == want * 2 and counts["a"].tolist() == [len(want), 0, len(want)]
    assert not both.a.number


def test_full_memory_keeps_what_comes_again():
    name = "byte_bpe_50k.json"
    own = tokens.Pieces(tokens.vocabulary(name), True, memory=2000)
    asked, learn = [], own._learn
    own._learn = lambda new: (asked.extend(new), learn(new))
    r = random.Random(5)
    often = ["often" + c for c in "abcdefgh"]
    texts = [" ".join(often + ["".join(r.choice("abcdefghijklmnop") for _ in range(9)) + r.choice([",", "", "!"]) for _ in range(400)]) for _ in range(40)]
    plain = Tokenizer.from_file(tokens.vocabulary(name))
    for t in texts:
        ids, _ = own.encode(pa.array([t]))
        assert ids.tolist() == plain.encode(t, add_special_tokens=False).ids
    assert all(asked.count(" " + w) == 1 for w in often[1:]) and len(own.number) < 4000


def test_packing_gets_arrow_batches_of_few_documents(spark, monkeypatch):
    sizes = []

    def cut(docs, *_):
        rows = docs.coalesce(1).mapInArrow(lambda batches: (pa.record_batch([[b.num_rows]], ["n"]) for b in batches), "n long")
        return rows

    def layout(staged, *_):
        sizes.extend(r.n for r in staged.collect())

    monkeypatch.setattr(packing, "cut", cut)
    monkeypatch.setattr(packing, "layout", layout)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    packing.pack(spark.range(2500), "")
    assert sum(sizes) == 2500 and max(sizes) <= 1000 and spark.conf.get(key) == before
