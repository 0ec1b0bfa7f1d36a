"""Byte-level BPE over ragged arrays: pre-tokens, rank-synchronous merging and word-wise encoding.

The vocabulary is a ``tokenizers`` JSON file of the byte-level kind; its path is a parameter and the file is read
where the tasks run.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import regex
from tokenizers import Tokenizer

from ledgerloom.llm.ragged import HashMap64, equal_spans, hash_spans, ranges, run_starts

#: The classes of characters that byte-level pre-tokens are made of.
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: A pre-token of more bytes is merged by the library: in one word merges follow one another, so that a round over all
#: of its symbols for each of them would take squared time.
LONG_WORD = 1 << 14
#: Words remembered by a worker before it starts anew; a bound on memory only, never on results.
MEMO_WORDS = 1 << 20
_NEVER = np.int64(1) << 40


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of every code point."""
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for first in range(0, 0x110000, 0x800):  # by blocks, as all of them at once take as much memory as the rest of a worker
        if not 0xD800 <= first < 0xE000:
            text = "".join(map(chr, range(first, first + 0x800)))
            for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
                for found in regex.finditer(pattern, text):
                    out[first + found.start() : first + found.end()] = kind
    return out


def pretokens(chars: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Start positions of the pre-tokens of all rows, in order; each ends where the next or its row's end is.

    chars: code points of all rows; offsets: row bounds. The pattern: contractions, then optional space and a run of
    letters, numbers or other signs, then white space (of which the last sign before a word stands apart).
    """
    if not len(chars):
        return np.zeros(0, dtype=np.int64)
    kind = char_classes()[chars]
    new_row = np.zeros(len(chars) + 1, dtype=bool)
    new_row[offsets] = True
    begin = new_row[:-1].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    white = kind == SPACE
    # the last white character before a word: a blank joins the word, any other stands alone
    before = white & ~np.r_[white[1:], False] & ~new_row[1:]
    last = np.flatnonzero(before)
    begin[last] = True
    blank = last[chars[last] == 32]
    begin[blank + 1] = False
    # contractions: a lone apostrophe that begins a pre-token, followed by one of a few letter groups
    quote = np.flatnonzero((chars == 39) & begin)
    if len(quote):
        row_end = offsets[np.searchsorted(offsets, quote, side="right")]
        padded = np.r_[chars, 0, 0, 0]
        one, two = padded[quote + 1], padded[quote + 2]
        one = np.where(quote + 1 < row_end, one, 0)
        two = np.where(quote + 2 < row_end, two, 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for found, size in ((quote[short], 2), (quote[long], 3)):
            begin[found + 1] = False
            after = found[found + size < len(chars)] + size
            # what follows begins a pre-token unless the blank rule below put it into white space already
            begin[after] = begin[after] | (kind[after] == LETTER)
    return np.flatnonzero(begin)


class Vocabulary:
    """Merge ranks of a vocabulary file as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        vocab = model["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        # printable bytes stand for themselves, the others for the code points from 256 on, in order
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        sign = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.byte_ids = np.array([vocab[sign[b]] for b in range(256)], dtype=np.int64)
        left = np.array([vocab[a] for a, _ in merges], dtype=np.uint64)
        right = np.array([vocab[b] for _, b in merges], dtype=np.uint64)
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.pairs = HashMap64(len(merges) * 2)
        self.pairs.put((left << np.uint64(32)) | right, np.arange(len(merges)))
        plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"]) for t in model["added_tokens"])
        if not plain:
            raise ValueError("special strings that take in their surroundings aren't supported")
        self.special = {t["content"].encode(): t["id"] for t in model["added_tokens"]}
        found = sorted(self.special, key=len, reverse=True)
        self.special_pattern = re.compile(b"|".join(map(re.escape, found))) if found else None

    def merge(self, symbols: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge all words at once. symbols: ids; words: the word of each, ascending. Returns both after merging.

        In each round every word applies its own lowest-rank pair, at all places of the word where it stands (of
        overlapping places every second one); words without a pair leave the rounds.
        """
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            same = words[1:] == words[:-1]
            at = np.flatnonzero(same)
            rank = np.full(len(symbols), _NEVER)
            found = self.pairs.get((symbols[at].astype(np.uint64) << np.uint64(32)) | symbols[at + 1].astype(np.uint64))
            rank[at] = np.where(found >= 0, found, _NEVER)
            heads = run_starts(words)
            sizes = np.diff(np.r_[heads, len(words)])
            lowest = np.minimum.reduceat(rank, heads)
            open_ = np.repeat(lowest < _NEVER, sizes)
            if not open_.all():
                done.append((symbols[~open_], words[~open_]))
            hit = open_ & (rank == np.repeat(lowest, sizes))
            places = np.flatnonzero(hit)
            if len(places):
                first = np.r_[True, np.diff(places) > 1]
                since = places - np.repeat(places[first], np.diff(np.r_[np.flatnonzero(first), len(places)]))
                places = places[since % 2 == 0]
                symbols = symbols.copy()
                symbols[places] = self.made[rank[places]]
                open_[places + 1] = False
            symbols, words = symbols[open_], words[open_]
        if not done:
            return symbols, words
        symbols, words = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(words, kind="stable")
        return symbols[order], words[order]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=2)
def library(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


class _Grown:
    """An array that doubles its space when it is full."""

    def __init__(self, kind: type):
        self.space, self.size = np.zeros(1 << 12, dtype=kind), 0

    def add(self, values: np.ndarray) -> None:
        while self.size + len(values) > len(self.space):
            self.space = np.r_[self.space, np.zeros_like(self.space)]
        self.space[self.size : self.size + len(values)] = values
        self.size += len(values)


class WordCodes:
    """A bounded memo in one worker: pre-tokens, found by their hash and told apart by their bytes, and their ids (both
    kept flat). by: 'arrays' or 'library'."""

    def __init__(self, path: str, by: str):
        self.path, self.by = path, by
        self.clear()

    def clear(self) -> None:
        self.map = HashMap64(1 << 12)
        self.ids, self.bounds = _Grown(np.uint32), _Grown(np.int64)
        self.text, self.text_bounds = _Grown(np.uint8), _Grown(np.int64)
        self.bounds.add(np.zeros(1, np.int64))
        self.text_bounds.add(np.zeros(1, np.int64))

    @property
    def n_words(self) -> int:
        return self.bounds.size - 1

    def _append(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Encode these pre-tokens and keep them; their rows."""
        text = flat[ranges(starts, ends - starts)]
        bounds = np.r_[0, np.cumsum(ends - starts)]
        ids, sizes = self._encode(text, bounds)
        rows = np.arange(self.n_words, self.n_words + len(starts))
        self.bounds.add(self.ids.size + np.cumsum(sizes))
        self.ids.add(ids)
        self.text_bounds.add(self.text.size + bounds[1:])
        self.text.add(text)
        return rows

    def rows(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Memo rows of the given pre-tokens; unknown ones are encoded first. A pre-token whose hash belongs to other
        bytes gets a row of its own, which no later one finds."""
        keys, inverse = np.unique(hash_spans(flat, starts, ends), return_inverse=True)
        if self.n_words + len(keys) > MEMO_WORDS and self.n_words:
            self.clear()
        rows = self.map.get(keys)
        new = np.flatnonzero(rows < 0)
        if len(new):
            one = np.zeros(len(keys), dtype=np.int64)
            one[inverse] = np.arange(len(starts))  # some occurrence of each key
            one = one[new]
            rows[new] = self._append(flat, starts[one], ends[one])
            self.map.put(keys[new], rows[new])
        got = rows[inverse]
        bounds = self.text_bounds.space
        odd = np.flatnonzero(~equal_spans(flat, starts, ends, self.text.space[: self.text.size], bounds[got], bounds[got + 1]))
        if len(odd):
            got[odd] = self._append(flat, starts[odd], ends[odd])
        return got

    def _encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of each word) of the words with these bounds in ``data``."""
        text = data.tobytes()
        cut = lambda which: [text[at[k] : at[k + 1]].decode() for k in which]
        if self.by == "library":
            return self._by_library(cut(range(len(at) - 1)))
        words = np.repeat(np.arange(len(at) - 1), np.diff(at))
        long = np.diff(at) > LONG_WORD
        short = ~long[words]
        vocab = vocabulary(self.path)
        symbols, owner = vocab.merge(vocab.byte_ids[data[short]], words[short])
        if long.any():
            which = np.flatnonzero(long)
            more, sizes = self._by_library(cut(which))
            symbols, owner = np.r_[symbols, more], np.r_[owner, np.repeat(which, sizes)]
            order = np.argsort(owner, kind="stable")
            symbols, owner = symbols[order], owner[order]
        return symbols.astype(np.uint32), np.bincount(owner, minlength=len(at) - 1)

    def _by_library(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = [np.zeros(0, dtype=np.uint32)], [np.zeros(0, dtype=np.int64)]
        for k in range(0, len(words), 1 << 14):  # as one sequence of given words: each is encoded by itself
            found = library(self.path).encode(words[k : k + (1 << 14)], is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(found.ids, dtype=np.uint32))
            sizes.append(np.bincount(found.word_ids, minlength=len(words[k : k + (1 << 14)])))
        return np.concatenate(ids), np.concatenate(sizes)

    def sizes(self, rows: np.ndarray) -> np.ndarray:
        return self.bounds.space[rows + 1] - self.bounds.space[rows]

    def codes(self, rows: np.ndarray) -> np.ndarray:
        """The ids of the given memo rows, one after another."""
        return self.ids.space[ranges(self.bounds.space[rows], self.sizes(rows))]


@lru_cache(maxsize=4)
def word_codes(path: str, by: str) -> WordCodes:
    return WordCodes(path, by)


def _specials(flat: np.ndarray, offsets: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, ids) of the special strings inside the rows."""
    found = [] if vocab.special_pattern is None else [(m.start(), m.end(), vocab.special[m.group()]) for m in vocab.special_pattern.finditer(flat.tobytes())]
    if found:
        row_end = offsets[np.searchsorted(offsets, [a for a, _, _ in found], side="right")]
        if any(b > e for (_, b, _), e in zip(found, row_end.tolist(), strict=True)):  # one across two rows hides others: row by row
            each = zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
            found = [(a + m.start(), a + m.end(), vocab.special[m.group()]) for a, b in each for m in vocab.special_pattern.finditer(flat[a:b].tobytes())]
    table = np.array(found, dtype=np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


def encode_rows(flat: np.ndarray, offsets: np.ndarray, path: str, by: str, with_ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows one after another, number of each row). by: how unknown pre-tokens are encoded. A special string
    is one id; what stands before and after it is encoded apart, as the library does by default."""
    codes = word_codes(path, by)
    chars = np.frombuffer(flat.tobytes().decode().encode("utf-32-le"), dtype="<u4")
    char_at = np.r_[np.flatnonzero((flat & 0xC0) != 0x80), len(flat)]
    s_starts, s_ends, s_ids = _specials(flat, offsets, vocabulary(path))
    cuts = np.unique(np.r_[offsets, s_starts, s_ends]) if len(s_starts) else offsets
    starts = char_at[pretokens(chars, np.searchsorted(char_at, cuts))]
    ends = np.r_[starts[1:], len(flat)][: len(starts)]
    if len(s_starts):
        before = np.searchsorted(s_starts, starts, side="right") - 1
        keep = (before < 0) | (starts >= s_ends[before])
        starts, ends = starts[keep], ends[keep]
    got = codes.rows(flat, starts, ends)
    sizes, ids = codes.sizes(got), codes.codes(got) if with_ids else np.zeros(0, dtype=np.uint32)
    if len(s_starts):
        order = np.argsort(np.r_[starts, s_starts], kind="stable")
        all_sizes = np.r_[sizes, np.ones(len(s_starts), dtype=np.int64)]
        if with_ids:
            first = np.cumsum(all_sizes) - all_sizes
            ids = np.r_[ids, s_ids.astype(np.uint32)][ranges(first[order], all_sizes[order])]
        starts, sizes = np.r_[starts, s_starts][order], all_sizes[order]
    row = np.searchsorted(offsets, starts, side="right") - 1
    return ids, np.bincount(row, weights=sizes, minlength=len(offsets) - 1).astype(np.int64)
