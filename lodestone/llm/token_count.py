"""Token counts by a compiled finite-state transducer.

A subword model that merges adjacent pieces by rank has an encoding whose prefixes are found from left to right: the encoding of a prefix ends in the one piece t
for which the piece before it and t do not merge otherwise. So a transducer can read a text one character at a time. Its state is, for each place within reach
of a piece, the place in the piece trie, the piece that ends there and the tokens since; reading a character leads to another such state and emits the change in the number of
tokens (which may be negative). States and transitions are made when first met, then kept in a hash table. A character that begins no piece together with
what precedes it starts a new segment, at which any state falls back to the start.

Every text is read in chunks of at most SPAN characters, cut where a segment starts. A chunk's state map says for a state before it which state follows and how
many tokens are emitted. The map of a chunk that starts a segment is constant; of any other it is a table of the states that can come before it, found
from the maps of the chunk before. Equal chunks (compared character by character, not by hash alone) have one map, and the maps of all distinct chunks of a batch
are run in step. Maps compose associatively, and a scan by pointer doubling composes those of each run of chunks up to the next constant one.

A text above PIECE characters is read piece by piece, the state carried from one to the next, so what is worked on stays bounded.

Only models of merge type with identity normalisation are compiled (sentencepiece's BPE with byte fallback); others are refused.

Cases: a null or empty text has 0 tokens and 0 bytes; null keys and rows that repeat a key stay; an empty table gives an empty result; special strings are
ordinary text, as the library takes them; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import encoding
from lodestone.llm._base import lean, picked, prepared, text_parts

SPACE = "▁"
#: Transitions kept by a worker (16 bytes each at least, and the states behind them); between two pieces it starts anew beyond.
KEPT = 1_500_000
#: Characters of a chunk, and of what is worked on together.
SPAN, PIECE = 32, 1 << 20
#: An odd base and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_compiled: dict[str, Transducer] = {}


class Merges:
    """Encoding short strings by the model's own rule: the best-scored adjacent pair merges first, leftmost of equals."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.bytes = any(model.is_byte(i) for i in range(n))
        self._check(model)

    def _check(self, model) -> None:
        """The rule must give what the library gives."""
        for probe in ("a  b", "Hello, world!\n\tx", "aaaaaaa", "① ﬁ é", "  lead and trail  ", "don't re-establish internationalization"):
            mine = sum(self.tokens(s) for s in segments(SPACE + probe.replace(" ", SPACE), self))
            if mine != len(model.encode(probe)):
                raise ValueError("this model does not merge by rank with identity normalisation")

    def pieces(self, s: str) -> list[str]:
        parts = list(s)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def cost(self, char: str) -> int:
        """Tokens of a character that is no piece."""
        return len(char.encode("utf-8", "surrogatepass")) if self.bytes else 1

    def tokens(self, s: str) -> int:
        return sum(1 if p in self.score else self.cost(p) for p in self.pieces(s))


def segments(s: str, merges: Merges) -> list[str]:
    """s cut before each space mark that follows another character, and around characters of no piece (for the check above; see Transducer.count for arrays)."""
    inner = set("".join(merges.score))
    out: list[str] = []
    for c in s:
        if out and c in inner and out[-1][-1] in inner and not (c == SPACE and out[-1][-1] != SPACE):
            out[-1] += c
        else:
            out.append(c)
    return out


class Transducer:
    """States are numbered, 0 is the start; a hash table holds state * classes + class + 1 in ``keys``, and beside it in ``to`` and ``emits`` what follows."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        if any(SPACE in p.lstrip(SPACE) for p in self.merges.score):
            raise ValueError("a piece of this model goes over a word's start")
        chars = sorted(set("".join(self.merges.score)))
        self.chars = ["", *chars]
        self.class_of = np.zeros(0x110000, np.uint16)
        self.class_of[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.space = int(self.class_of[ord(SPACE)])
        cost = np.ones(0x110000, np.uint8)
        if self.merges.bytes:
            cost[0x80:], cost[0x800:], cost[0x10000:] = 2, 3, 4
        self.cost = cost
        self.starts = {p[:k] for p in self.merges.score for k in range(1, len(p))}  # proper prefixes of pieces
        self.fits: dict[tuple[str, str], bool] = {}
        self.spread = np.random.default_rng(3).integers(1, 1 << 63, len(self.chars) + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.powers = [np.cumprod(np.append(np.ones(1, np.uint64), np.full(2 * PIECE, b, np.uint64))) for b in (_BASE, _INVERSE)]
        self._clear()

    def _clear(self) -> None:
        start = (("", "", 0),)
        self.states, self.number, self.known = [start], {start: 0}, 0
        self._resize(1 << 16)

    def _resize(self, slots: int) -> None:
        self.keys, self.to, self.emits = np.zeros(slots, np.int64), np.zeros(slots, np.int32), np.zeros(slots, np.int32)

    def _slots(self, key: np.ndarray) -> np.ndarray:
        h = key.astype(np.uint64) * np.uint64(_BASE)
        return (h >> np.uint64(40)).astype(np.int64) & (len(self.keys) - 1)

    def _put(self, key: np.ndarray, to: np.ndarray, emits: np.ndarray) -> None:
        """New transitions into free slots."""
        slot, open_ = self._slots(key), np.arange(len(key))
        while len(open_):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.to[slot[put]], self.emits[slot[put]] = key[open_[put]], to[open_[put]], emits[open_[put]]
            more = np.ones(len(open_), bool)
            more[put] = False
            open_, slot = open_[more], (slot[more] + 1) & (len(self.keys) - 1)

    def _fit(self, left: str, right: str) -> bool:
        """Whether left and right stay two pieces when they are next to each other."""
        known = self.fits.get((left, right))
        if known is None:
            known = not left or self.merges.pieces(left + right) == [left, right]
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            self.fits[left, right] = known
        return known

    def _number(self, state: tuple) -> int:
        number = self.number.get(state)
        if number is None:
            number = self.number[state] = len(self.states)
            self.states.append(state)
        return number

    def _follow(self, state: int, cls: int) -> tuple[int, int]:
        """A new transition. A state's items: (open prefix of a piece, piece that ends before it, tokens up to there less tokens up to now)."""
        c = self.chars[cls]
        items, last, count = [], "", None
        for open_, before, tokens in self.states[state]:  # longest open prefix first
            grown = open_ + c
            if count is None and (len(grown) == 1 or grown in self.merges.score) and self._fit(before, grown):
                last, count = grown, tokens + 1
            if grown in self.starts:
                items.append((grown, before, tokens))
        if count is None:
            raise ValueError("no piece ends here")
        return self._number((*((p, b, t - count) for p, b, t in items), ("", last, 0))), count

    def _places(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the keys, and which have none (they point at a free slot)."""
        at = self._slots(key)
        there = self.keys[at]
        off = np.flatnonzero((there != key) & (there != 0))
        while len(off):
            at[off] = (at[off] + 1) & (len(self.keys) - 1)
            there = self.keys[at[off]]
            off = off[(there != key[off]) & (there != 0)]
        return at, np.flatnonzero(self.keys[at] == 0)

    def _step(self, state: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = state.astype(np.int64) * len(self.chars) + cls + 1
        at, missing = self._places(key)
        if len(missing):
            new = np.unique(key[missing])
            made = np.array([self._follow(*divmod(int(k) - 1, len(self.chars))) for k in new], np.int32)
            if 2 * (self.known + len(new)) > len(self.keys):
                full = np.flatnonzero(self.keys)
                was = self.keys[full], self.to[full], self.emits[full]
                size = len(self.keys)
                while 2 * (self.known + len(new)) > size:
                    size *= 4
                self._resize(size)
                self._put(*was)
            self._put(new, made[:, 0], made[:, 1])
            self.known += len(new)
            at, _ = self._places(key)
        return self.to[at], self.emits[at]

    def run(self, cls: np.ndarray, start: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state after, tokens) of the chunks cls[start : start + size] read from these states, in step: each chunk reads a character a round."""
        order = np.argsort(-size, kind="stable")
        start, size, state = start[order], size[order], state[order].astype(np.int32)
        total = np.zeros(len(order), np.int64)
        live, k = len(order), 0
        while live:
            state[:live], emitted = self._step(state[:live], cls[start[:live] + k])
            total[:live] += emitted
            k += 1
            live = int(np.searchsorted(-size[:live], -k, side="left"))
        after, tokens = np.empty_like(state), np.empty_like(total)
        after[order], tokens[order] = state, total
        return after, tokens

    def _distinct(self, cls: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(one chunk of each kind, the kind of each chunk). Chunks of equal hash are compared with their first, and are kinds of their own where they differ."""
        total = np.append(np.zeros(1, np.uint64), np.cumsum(self.spread[cls] * self.powers[0][: len(cls)]))
        h = (total[start + size] - total[start]) * self.powers[1][start]
        h ^= h >> np.uint64(32)
        h = h * np.uint64(_BASE) + size.astype(np.uint64)
        _, first, of = np.unique(h, return_index=True, return_inverse=True)
        like = first[of]
        other = size != size[like]
        ends = np.cumsum(size)
        mine = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)
        theirs = np.minimum(mine + np.repeat(start[like] - start, size), len(cls) - 1)
        differs = np.flatnonzero(cls[mine] != cls[theirs])
        other[np.searchsorted(ends, differs, side="right")] = True
        alone = np.flatnonzero(other)
        of[alone] = len(first) + np.arange(len(alone))
        return np.append(first, alone), of

    def read(self, code: np.ndarray, edge: np.ndarray, before: int = 0, state: tuple | None = None) -> tuple[np.ndarray, np.ndarray, tuple]:
        """(where parts begin, their tokens, the state after the last). code: code points of texts one after another, edge: where texts begin (0 is such a place
        unless state says in which state the text's part ahead ended, and before which class its last character had)."""
        if self.known > KEPT:
            self._clear()
        cls = self.class_of[code].astype(np.int64)
        last = np.append(np.int64(before), cls[:-1])
        first = (cls == 0) | (last == 0) | ((cls == self.space) & (last != self.space))
        first[edge] = True
        segment = np.flatnonzero(np.append(True, first[1:]))
        begins = first.copy()
        within = np.arange(len(cls)) - np.repeat(segment, np.diff(np.append(segment, len(cls))))
        begins |= within % SPAN == 0
        start = np.flatnonzero(begins)
        size, constant = np.diff(np.append(start, len(cls))), first[start]
        tokens, after = self.cost[code[start]].astype(np.int64), np.zeros(len(start), np.int32)
        inner = np.flatnonzero(cls[start] != 0)
        kind = np.full(len(start), -1, np.int64)
        one, kind[inner] = self._distinct(cls, start[inner], size[inner])
        one = inner[one]
        to, emits = self.run(cls, start[one], size[one], np.zeros(len(one), np.int32))
        after[inner], tokens[inner] = to[kind[inner]], emits[kind[inner]]
        carried = 0 if constant[0] else self._number(state or self.states[0])
        follow = np.flatnonzero(~constant)
        if len(follow):
            tokens[follow] = 0
            begin, end, chain = self._composed(cls, start[one], size[one], kind, follow, after, carried)
            tokens[begin] = chain
            after[end[:, 0]] = end[:, 1]
        return start, tokens, self.states[after[-1]] if cls[-1] else self.states[0]

    def _composed(self, cls: np.ndarray, start: np.ndarray, size: np.ndarray, kind: np.ndarray, follow: np.ndarray, after: np.ndarray, carried: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each run of chunks whose maps are not constant: its first chunk, (its last chunk, the state after it), its tokens. The maps' tables are made
        state by state as the maps before them give these, and composed by pointer doubling."""
        follows = np.zeros(len(kind) + 1, bool)
        follows[follow] = True
        chunk, entry = follow, np.where(follow > 0, after[follow - 1], carried).astype(np.int64)
        true = np.flatnonzero(~follows[chunk - 1] | (chunk == 0))  # what is before is constant
        rows: list[tuple[np.ndarray, ...]] = []
        known, known_to, known_emits = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        seen = np.zeros(0, np.int64)
        while len(chunk):
            pair, back = np.unique(kind[chunk] << 32 | entry, return_inverse=True)
            new = pair[~np.isin(pair, known)]
            if len(new):
                to, emits = self.run(cls, start[new >> 32], size[new >> 32], new & 0xFFFFFFFF)
                order = np.argsort(np.append(known, new), kind="stable")
                known, known_to, known_emits = np.append(known, new)[order], np.append(known_to, to)[order], np.append(known_emits, emits)[order]
            at = np.searchsorted(known, pair)[back]
            rows.append((chunk, entry, known_to[at], known_emits[at]))
            seen = np.sort(np.append(seen, chunk << 32 | entry))
            go = follows[chunk + 1]
            ahead = np.unique((chunk[go] + 1) << 32 | known_to[at][go])
            ahead = ahead[~np.isin(ahead, seen)]
            chunk, entry = ahead >> 32, ahead & 0xFFFFFFFF
        chunk, entry, to, emits = (np.concatenate(x) for x in zip(*rows, strict=True))
        key = chunk << 32 | entry
        order = np.argsort(key)
        key, chunk, to, emits = key[order], chunk[order], to[order], emits[order]
        end = np.arange(len(key))
        go = follows[chunk + 1]
        ahead = np.full(len(key), -1, np.int64)
        ahead[go] = np.searchsorted(key, (chunk[go] + 1) << 32 | to[go])
        first = np.searchsorted(key, rows[0][0][true] << 32 | rows[0][1][true])
        while (on := np.flatnonzero(ahead >= 0)).size:
            step = ahead[on]
            emits[on], end[on], ahead[on] = emits[on] + emits[step], end[step], ahead[step]
        return chunk[first], np.stack([chunk[end[first]], to[end[first]]], axis=1), emits[first]

    def count(self, texts: list[str], piece: int = PIECE) -> np.ndarray:
        """Tokens of each text; of one text alone, piece by piece."""
        if len(texts) == 1:
            total, before, state = 0, 0, None
            for a in range(0, len(texts[0]), piece):
                marked = (SPACE if a == 0 else "") + texts[0][a : a + piece].replace(" ", SPACE)
                code = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), "<u4")
                _, tokens, state = self.read(code, np.zeros(1 if a == 0 else 0, np.int64), before, state)
                total, before = total + int(tokens.sum()), int(self.class_of[code[-1]])
            return np.array([total], np.int64)
        marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        size = np.fromiter(map(len, marked), np.int64, len(marked))
        code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4")
        edge = (np.cumsum(size) - size)[size > 0]
        if not len(code):
            return np.zeros(len(texts), np.int64)
        start, tokens, _ = self.read(code, edge)
        doc = np.searchsorted(np.cumsum(size), start, side="right")
        return np.bincount(doc, tokens, minlength=len(texts)).astype(np.int64)


def machine(path: str) -> Transducer:
    """One for each model file and worker."""
    if path not in _compiled:
        _compiled[path] = Transducer(path)
    return _compiled[path]


def _counting(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(path)
        for batch in batches:
            out = [np.zeros(0, np.int64)]
            out += [m.count(texts) for _, _, texts in text_parts(batch.column("text"), PIECE)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n_bytes"), pa.array(np.concatenate(out))], ["key", "n_bytes", "n_tokens"])

    return run


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None, limit: int = 4096) -> DataFrame:
    """One row a document: key, n_bytes (UTF-8), n_tokens, over_limit."""
    prepared(docs.sparkSession)
    path = model or encoding.default_path("piece_bpe_32k.model")
    rows = picked(docs, key=key, text=text).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return rows.mapInArrow(lean(_counting(path)), schema).select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
