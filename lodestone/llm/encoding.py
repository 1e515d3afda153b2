"""Token ids by the tokenizers library, in each Python worker.

A byte-level BPE without normaliser or post-processor encodes its pre-tokens one by one, so each distinct pre-token goes through the
library once and its ids are then looked up in a hash table of arrays, a batch of texts at a time. Every hit is compared with the stored
characters; a pre-token whose hash belongs to another goes through the library anew. This holds for texts of Latin
characters, whose pre-tokens are found here by character classes; a text with any other character, or with an added token's string
in it, goes through the library whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa

#: Characters whose class (letter, number, space, other) is certain; those left out are of other scripts, or numbers that are no digits.
UNSURE = re.compile("[^\t\n\r\x20-\x7e\xa0-\xac\xae-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]")
OTHER, LETTER, NUMBER, WHITE = range(4)
#: Slots of a worker's table of pre-tokens, and characters or ids stored with them; it starts anew when half or all are taken (about 100 MB then).
SLOTS, STORED = 1 << 21, 1 << 24
#: Characters of texts that callers should hand over at a time; what is worked on takes about 100 bytes a character.
CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_encoders: dict[str, Encoder] = {}


def _classes() -> np.ndarray:
    out = np.full(0x250, OTHER, np.uint8)
    for c in range(0x250):
        if chr(c).isalpha():
            out[c] = LETTER
        elif chr(c) in "0123456789":
            out[c] = NUMBER
        elif chr(c) in "\t\n\r \xa0":
            out[c] = WHITE
    return out


_CLASS = _classes()


def pretokens(code: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin. code: code points of texts one after another; first: where each (not empty) text begins.

    Letters, numbers and others run together, with one space ahead of a run; a run of white space leaves its last character to what follows it in
    its text; an apostrophe without a space ahead takes s, t, m, d, re, ve or ll with it.
    """
    cls = _CLASS[code]
    n = len(code)
    fresh = np.zeros(n + 1, bool)  # a text begins
    fresh[first] = True
    fresh[n] = True
    run = np.ones(n + 1, bool)  # a run of one class begins
    run[1:n] = (cls[1:] != cls[:-1]) | fresh[1:n]
    begin = run[:n].copy()
    spaced = np.zeros(n, bool)  # a space ahead, in the same text
    spaced[1:] = (code[:-1] == 32) & ~fresh[1:n]
    white = cls == WHITE
    begin &= white | ~spaced
    last = np.flatnonzero(white & run[1:] & ~fresh[1:])  # last of a white run that something follows
    begin[last] = True
    mark = np.flatnonzero((code == 39) & run[:n] & run[1:] & ~spaced)
    mark = mark[(mark + 1 < n) & ~fresh[np.minimum(mark + 1, n)]]
    if len(mark):
        a = code[mark + 1]
        two = np.minimum(mark + 2, n - 1)
        b = np.where((mark + 2 < n) & ~fresh[np.minimum(mark + 2, n)], code[two], 0)
        taken = np.where(np.isin(a, [115, 116, 109, 100]), 1, np.where(((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108)), 2, 0))
        mark, taken = mark[taken > 0], taken[taken > 0]
        begin[mark + 1] = False
        after = mark + 1 + taken
        ok = after < n
        after = after[ok]
        begin[after[cls[after] == LETTER]] = True
    return np.flatnonzero(begin)


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        said = json.loads(self.tokenizer.to_str())
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        pre = said["pre_tokenizer"] or {}
        self.splits = said["normalizer"] is None and said["post_processor"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        added = [x["content"] for x in said["added_tokens"]]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.spread = np.random.default_rng(4).integers(1, 1 << 63, 0x250, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
        self._clear()

    def _clear(self) -> None:
        self.keys, self.entry = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
        self.at, self.size = np.zeros(SLOTS // 2 + 1, np.int64), np.zeros(SLOTS // 2 + 1, np.int32)
        self.pool, self.used, self.known = np.zeros(1 << 16, self.kind), 0, 0
        self.char_at, self.char_size = np.zeros(SLOTS // 2 + 1, np.int64), np.zeros(SLOTS // 2 + 1, np.int32)
        self.chars, self.written = np.zeros(1 << 16, np.uint16), 0

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, dtype=self.kind) for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _ids(self, words: list[str]) -> list[np.ndarray]:
        """Ids of pre-tokens. Those of letters, with or without a space ahead, go through the library many at a time: each follows a digit, which is a
        pre-token of its own, and the library's word numbers take them apart again."""
        letters = [i for i, w in enumerate(words) if w.isalpha() or (w[0] == " " and w[1:].isalpha())]
        out: list[np.ndarray | None] = [None] * len(words)
        for k in range(0, len(letters), 512):
            part = letters[k : k + 512]
            found = self.tokenizer.encode("1" + "1".join([words[i] for i in part]), add_special_tokens=False)
            of, ids = np.array(found.word_ids), np.array(found.ids, dtype=self.kind)
            if of[-1] != 2 * len(part) - 1:
                raise ValueError("the library splits these words otherwise")
            at = np.searchsorted(of, np.arange(2 * len(part) + 1)).tolist()
            for i, a, b in zip(part, at[1::2], at[2::2], strict=True):
                out[i] = ids[a:b]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self._whole([words[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Entries of the hashes; -1 where there is none."""
        out = np.full(len(h), -1, np.int32)
        slot, open_ = (h & np.uint64(SLOTS - 1)).astype(np.int64), np.arange(len(h))
        while len(open_):
            there = self.keys[slot]
            hit = there == h[open_]
            out[open_[hit]] = self.entry[slot[hit]]
            more = ~hit & (there != 0)
            open_, slot = open_[more], (slot[more] + 1) & (SLOTS - 1)
        return out

    def _store(self, begin: np.ndarray, end: np.ndarray, code: np.ndarray) -> None:
        """Keep the characters code[begin : end] of the entries that come next."""
        sizes = end - begin
        total = int(sizes.sum())
        if self.written + total > len(self.chars):
            self.chars = np.concatenate([self.chars, np.zeros(max(total, len(self.chars)), np.uint16)])
        new, upto = np.arange(self.known, self.known + len(begin)), np.cumsum(sizes)
        self.char_at[new], self.char_size[new] = self.written + upto - sizes, sizes
        self.chars[self.written : self.written + total] = code[np.repeat(begin - (upto - sizes), sizes) + np.arange(total)]
        self.written += total

    def _others(self, found: np.ndarray, begin: np.ndarray, end: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Which pre-tokens (one after another, all of code) are not their entry's characters, though the hash is the same."""
        size = end - begin
        wrong = self.char_size[found] != size
        at = np.where(wrong, 0, self.char_at[found]) - begin
        place = np.repeat(at, size) + np.arange(len(code))
        if wrong.any():
            place[place >= len(self.chars)] = 0
        differs = np.flatnonzero(self.chars[place] != code)
        if len(differs):
            wrong[np.searchsorted(begin, differs, side="right") - 1] = True
        return np.flatnonzero(wrong)

    def _add(self, h: np.ndarray, ids: list[np.ndarray]) -> None:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(sizes.sum())
        if self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(total, len(self.pool)), self.kind)])
        new = np.arange(self.known, self.known + len(h))
        self.at[new], self.size[new] = self.used + np.cumsum(sizes) - sizes, sizes
        self.pool[self.used : self.used + total] = np.concatenate(ids)
        self.used, self.known = self.used + total, self.known + len(h)
        slot, open_ = (h & np.uint64(SLOTS - 1)).astype(np.int64), np.arange(len(h))
        while len(open_):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.entry[slot[put]] = h[open_[put]], new[open_[put]]
            more = np.ones(len(open_), bool)
            more[put] = False
            open_, slot = open_[more], (slot[more] + 1) & (SLOTS - 1)

    def _split(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain texts one after another, and their numbers."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        whole = "".join(texts)
        code = np.frombuffer(whole.encode("utf-32-le"), "<u4").astype(np.int32)
        if not len(code):
            return np.zeros(0, self.kind), np.zeros(len(texts), np.int64)
        if len(self.powers[0]) <= len(code):
            for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
                self.powers[k] = np.cumprod(np.append(np.ones(1, np.uint64), np.full(max(len(code), CHUNK), base, np.uint64)))
        begin = pretokens(code, (np.cumsum(size) - size)[size > 0])
        end = np.append(begin[1:], len(code))
        run = np.append(np.zeros(1, np.uint64), np.cumsum(self.spread[code] * self.powers[0][: len(code)]))
        h = (run[end] - run[begin]) * self.powers[1][begin]
        h ^= h >> np.uint64(32)
        h *= np.uint64(_BASE)
        h ^= h >> np.uint64(29)
        h |= np.uint64(1 << 63)  # never 0, which marks a free slot
        found = self._find(h)
        missed = np.flatnonzero(found < 0)
        if len(missed):
            new, one = np.unique(h[missed], return_index=True)
            if self.known + len(new) > SLOTS // 2 or max(self.written, self.used) > STORED:
                self._clear()
                missed = np.arange(len(h))
                new, one = np.unique(h, return_index=True)
                if len(new) > SLOTS // 2:
                    ids = self._whole(texts)
                    return np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids))
            first = missed[one]
            self._store(begin[first], end[first], code)
            self._add(new, self._ids([whole[a:b] for a, b in zip(begin[first].tolist(), end[first].tolist(), strict=True)]))
            found[missed] = self._find(h[missed])
        at, sizes, pool = self.at[found], self.size[found].astype(np.int64), self.pool
        other = self._others(found, begin, end, code)
        if len(other):  # of equal hash alone
            own = self._ids([whole[a:b] for a, b in zip(begin[other].tolist(), end[other].tolist(), strict=True)])
            sizes[other] = np.fromiter(map(len, own), np.int64, len(own))
            at[other] = self.used + np.cumsum(sizes[other]) - sizes[other]
            pool = np.concatenate([pool[: self.used], *own])
        stop = np.cumsum(sizes)
        ids = pool[np.repeat(at - (stop - sizes), sizes) + np.arange(int(stop[-1]))]
        upto = np.append(0, stop)[np.searchsorted(begin, np.cumsum(size))]
        return ids, np.diff(np.append(0, upto))

    def encode(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, each followed by end (if given), and the number of each."""
        plain = [self.splits and not UNSURE.search(t) and not (self.added and self.added.search(t)) for t in texts]
        ids, counts = self._split([t for t, p in zip(texts, plain, strict=True) if p])
        if not all(plain):
            parts = iter(np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else [])
            whole = iter(self._whole([t for t, p in zip(texts, plain, strict=True) if not p]))
            own = [next(parts) if p else next(whole) for p in plain]
            ids, counts = np.concatenate(own).astype(self.kind, copy=False), np.fromiter(map(len, own), np.int64, len(own))
        if end is None:
            return ids, counts
        out = np.full(len(ids) + len(texts), end, self.kind)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), counts)] = ids
        return out, counts + 1


def encoder(path: str) -> Encoder:
    """One for each tokenizer file and worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def rows_of(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of the pieces of data that end at ends."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.append(0, ends).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())
