"""Public tokenizers over Arrow batches.

Both vocabularies split a text at every blank that a visible character follows (or every blank at all), so the ids of a text are those of its
blank-separated pieces one after another. A batch is cut into pieces and dictionary-encoded in Arrow, and only pieces not seen before by this
worker go through the tokenizer; texts with other white space around a blank go through it whole. A line feed behind a visible character begins a
piece as well (it is white space that the word vocabulary drops, and never joins what is before it). A new piece that is one word of Latin-1
letters goes straight to the tokenizer's model: such words need no normalising and are one unit for it. A line feed before a word and ASCII marks
behind it are units of their own, so a piece with them is put together from its parts, each tokenized once.
"""

from __future__ import annotations

import gc
import re
from itertools import chain, compress, filterfalse
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.llm.common import release, sliced

#: Pieces that a worker remembers (about 200 bytes each); when full it drops those of one batch only, which most are.
MEMORY = 500_000
#: Bytes of text that are cut at a time.
STEP = 1 << 22
# White space that a piece must not start with.
_AWKWARD = r" [ \t\n\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# A line feed behind a visible character.
_LINE = r"([^ \t\n\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}])\n"

# A word, perhaps with ASCII marks behind it (no apostrophe: both vocabularies have units that begin with one).
_PLAIN = re.compile(r"(\n?)( ?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def _visible() -> dict[int, str]:
    """Latin-1 characters as byte-level vocabularies write their UTF-8 bytes: visible Latin-1 bytes as they are, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    name = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return {c: "".join(name[b] for b in chr(c).encode()) for c in range(256)}


def _strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


def vocabulary(name: str) -> str:
    """Place of a public tokenizer file; the parameter of every function that tokenizes."""
    import public_tokenizers
    return public_tokenizers.path(name)


class Pieces:
    """Ids of pieces: a piece's number leads to its stretch of one growing array."""

    def __init__(self, path: str, blanks: bool, memory: int = MEMORY):
        from tokenizers import Tokenizer
        self.tokenizer, self.blanks, self.memory = Tokenizer.from_file(path), blanks, memory
        self.model, self.letters, self.job = self.tokenizer.model, _visible(), ""
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.seen = np.zeros(1 << 16, np.int64)  # look-ups that asked for a piece, halved whenever some are dropped

    def _thin(self) -> None:
        """Drops the pieces asked for once, or more of the seldom ones, so that less than half of the memory stays in use."""
        seen, half = self.seen[:len(self.number)], max(1, self.memory // 2)
        keep = seen > max(1, int(np.partition(seen, len(seen) - half)[len(seen) - half]))
        names, at = list(compress(self.number, keep.tolist())), np.flatnonzero(keep)
        flat, sizes, seen = self._gather([(self.ids, self.start[at], self.size[at], None)]), self.size[at], seen[at] // 2
        self.forget()
        self._keep(names, flat, sizes)
        self.seen[:len(seen)] = seen

    def look_up(self, pieces: list[str]) -> np.ndarray:
        """Numbers of the pieces; tokenizes those that are new."""
        if len(self.number) > self.memory:
            self._thin()
        number = self.number
        new = list(filterfalse(number.__contains__, dict.fromkeys(pieces)))
        collects = gc.isenabled()
        gc.disable()  # what the model returns is many small lists, none in a cycle
        try:
            for at in range(0, len(new), 20_000):
                self._learn(new[at:at + 20_000])
        finally:
            if collects:
                gc.enable()
        found = np.fromiter(map(number.__getitem__, pieces), np.int64, len(pieces))
        self.seen[found] += 1
        return found

    def tokenized(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, for callers that keep their own memory: nothing stays here."""
        of = self.look_up(texts)
        flat, starts, sizes = self.ids[:self.used].tolist(), self.start[of], self.size[of]
        self.forget()
        return [flat[s:e] for s, e in zip(starts.tolist(), (starts + sizes).tolist())]

    def _learn(self, new: list[str]) -> None:
        """Adds new pieces: words by the model; words with a line feed before or marks behind from their parts; others by the whole tokenizer."""
        match, blanks, number = _PLAIN.fullmatch, self.blanks, self.number
        words, joined, parts, other = [], [], [], []
        for p in filterfalse(number.__contains__, new):  # a part of one before may be among them
            if blanks and p[:1] == " " and p.isascii() and p[1:].isalpha():  # most of them
                words.append(p)
                continue
            m = match(p)
            if m is None:
                other.append(p)
                continue
            line, blank, word, marks = m.groups()
            word = blank + word if blanks else word.lower()  # without blanks the vocabulary is one of lower-case words
            if word == p:
                words.append(p)
            else:
                joined.append(p)
                parts += line, word, marks
        own = set(words)
        for p in filterfalse(number.__contains__, dict.fromkeys(parts)):
            if p not in own:
                (words if p[-1:].isalpha() else other).append(p)
        other = list(filterfalse(number.__contains__, dict.fromkeys(other)))
        blank, letters = self.letters[32], self.letters
        found = list(map(self.model.tokenize, [p.replace(" ", blank) if p.isascii() else p.translate(letters) for p in words]))
        self._keep(words, np.fromiter(map(attrgetter("id"), chain.from_iterable(found)), np.uint32), np.fromiter(map(len, found), np.int64, len(found)))
        found = [e.ids for e in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)]
        self._keep(other, np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found)))
        if joined:
            of = np.fromiter(map(number.__getitem__, parts), np.int64, len(parts))
            sizes = self.size[of]
            self._keep(joined, self._gather([(self.ids, self.start[of], sizes, None)]), sizes.reshape(-1, 3).sum(axis=1))

    def _keep(self, pieces: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        first, end = len(self.number), len(self.number) + len(pieces)
        while end > len(self.start):
            self.start, self.size, self.seen = (np.append(x, np.zeros_like(x)) for x in (self.start, self.size, self.seen))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        self.ids[self.used:self.used + len(flat)] = flat
        self.size[first:end] = sizes
        self.start[first:end] = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        self.number.update(zip(pieces, range(first, end)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each). Null is the empty text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy())
        out, counts, i = [], [], 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + STEP, "right")))
            ids, n = self._some(texts.slice(i, j - i))
            out.append(ids)
            counts.append(n)
            i = j
        return (np.concatenate(out), np.concatenate(counts)) if out else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _some(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        whole = pc.match_substring_regex(texts, _AWKWARD).to_numpy(zero_copy_only=False) if self.blanks else np.zeros(len(texts), bool)
        cut = pc.if_else(pa.array(whole), "", texts)
        split = pc.split_pattern(pc.replace_substring_regex(cut, _LINE, "\\1 \n") if self.blanks else pc.replace_substring(cut, "\n", " "), " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        names, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        if self.blanks:
            # all pieces but a text's first begin with their blank, or with their line feed
            heads = offsets[:-1]
            later = np.ones(len(code), bool)
            later[heads] = False
            numbers = np.empty(len(code), np.int64)
            used = np.zeros(len(names), bool)
            used[code[later]] = True
            table = np.zeros(len(names), np.int64)
            rest = names.filter(pa.array(used))
            table[used] = self.look_up(_strings(pc.if_else(pc.starts_with(rest, "\n"), rest, pc.binary_join_element_wise(pa.scalar(" ", rest.type), rest, pa.scalar("", rest.type)))))
            size, start = self.size[table], self.start[table]
            sizes, starts = size[code], start[code]
            # the first pieces are looked up apart; their ids are taken before the memory can turn over
            pool = self.ids[:self.used].copy() if len(self.number) > self.memory else None
            firsts = self.look_up(_strings(names.take(pa.array(code[heads]))))
            if pool is not None:
                ids = self._gather([(pool, starts, sizes, later), (self.ids, self._at(firsts, heads, len(code), self.start), self._at(firsts, heads, len(code), self.size), ~later)])
                sizes = np.where(later, sizes, self._at(firsts, heads, len(code), self.size))
            else:
                sizes[heads], starts[heads] = self.size[firsts], self.start[firsts]
                ids = self._gather([(self.ids, starts, sizes, None)])
        else:
            table = self.look_up(_strings(names))
            sizes, starts = self.size[table][code], self.start[table][code]
            ids = self._gather([(self.ids, starts, sizes, None)])
        counts = np.append(0, np.cumsum(sizes))[offsets]
        counts = counts[1:] - counts[:-1]
        if whole.any():
            ids, counts = self._insert(texts, whole, ids, counts)
        return ids, counts

    @staticmethod
    def _at(values: np.ndarray, places: np.ndarray, n: int, of: np.ndarray) -> np.ndarray:
        full = np.zeros(n, np.int64)
        full[places] = of[values]
        return full

    @staticmethod
    def _gather(sources) -> np.ndarray:
        sizes = sum(np.where(mask, s, 0) if mask is not None else s for _, _, s, mask in sources)
        before = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), np.uint32)
        for pool, starts, own, mask in sources:
            pick = np.arange(len(sizes)) if mask is None else np.flatnonzero(mask)
            n = own[pick]
            at, first = np.arange(int(n.sum())), np.cumsum(n) - n
            out[np.repeat(before[pick] - first, n) + at if mask is not None else slice(None)] = pool[np.repeat(starts[pick] - first, n) + at]
        return out

    def _insert(self, texts: pa.Array, whole: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(whole)
        found = [np.array(self.tokenizer.encode_batch_fast([texts[int(k)].as_py()], add_special_tokens=False)[0].ids, np.uint32) for k in at]
        ends, counts = np.cumsum(counts), counts.copy()
        parts, last = [], 0
        for k, own in zip(at, found):
            parts += [ids[last:ends[k]], own]
            last = ends[k]
            counts[k] = len(own)
        return np.concatenate([*parts, ids[last:]]), counts


def small_batches(batches, forget: bool = True, step: int = STEP):
    """Batches cut into smaller ones of `step` bytes, so that the arrays made from one (some 25 times that) stay small; what a task remembers of pieces ends with the task, or else stays for
    the worker's next one of the same job (MEMORY pieces at most, see `pieces`)."""
    try:
        yield from sliced(batches, step)
    finally:
        if forget:
            for known in _known.values():
                known.forget()
        release()


_known: dict[tuple[str, bool, int], Pieces] = {}


def pieces(path: str, blanks: bool, memory: int = MEMORY, job: str = "") -> Pieces:
    """This worker's memory for a vocabulary. `blanks`: pieces keep the blank before them. Another `job` finds it empty: what it has to tokenize does not
    depend on what ran before it."""
    key = path, blanks, memory
    if key not in _known:
        _known[key] = Pieces(*key)
    known = _known[key]
    if known.job != job:
        known.forget()
        known.job = job
    return known
