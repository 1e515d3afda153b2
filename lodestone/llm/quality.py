"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation estimates how far each can be trusted, and the posterior decides.

Each rule looks at counts of one whole text and votes 1 (fine), -1 (junk) or 0 (abstains). A text's class is hidden; given the class, rules vote independently, and
a rule that votes says 1 with a chance of its own for fine texts (``hit``) and for junk (``fall``). These chances and the share of fine texts are fitted by
expectation-maximisation to the histogram of vote patterns of all documents: at most ``3 ** len(RULES)`` rows, whatever the number of documents. No label is read.
``kept`` asks the posterior for at least a half and the base rules not to fail; a text that fails one rule may stay, where that rule is known to be wrong at times.

Memory: a text is split a piece at a time; its words are small integers (8 bytes a word, sorted once), its lines a set of their bytes.

Cases: a null text is empty; a text without words has counts of 0 and fails the base rules; ids may repeat or be null and each row is judged by itself, so repeated rows
agree; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import io
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm._base import lean, picked, prepared, table
from lodestone.llm.terms import SPACES, WORDS, terms, texts

SYMBOLS = b"#*$%&|<>"
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
#: Bytes that go on with a character.
LATER = bytes(range(128, 192))
#: What is counted of a text: words, their code points, symbols, lines equal to an earlier one, words in repeated 3-word windows; lines with a word, exclamation marks,
#: ASCII capitals and small letters, occurrences of its most frequent word, words that end a sentence.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_upper", "n_lower", "n_top_word", "n_ends")
BASE_FAILS = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
ENDS = (b".", b"!", b"?", b":", "。".encode(), "！".encode(), "？".encode())


@dataclass(frozen=True)
class Rule:
    """Votes 1 where ``fine`` holds, else -1 where ``junk`` holds, else abstains; both are SQL conditions over COUNTS, free of rounding."""

    name: str
    fine: str
    junk: str


RULES = (
    Rule("symbols", "n_words > 0 AND 50 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    Rule("exclamations", "n_words > 0 AND 20 * n_marks <= n_words", "5 * n_marks > n_words"),
    Rule("capitals", "n_lower > 0 AND 5 * n_upper <= n_upper + n_lower", "2 * n_upper > n_upper + n_lower"),
    Rule("repeated_windows", "n_words >= 3 AND 5 * n_repeat_words <= n_words", "5 * n_repeat_words > 2 * n_words"),
    Rule("repeated_lines", "n_lines >= 2 AND 10 * n_dup_lines <= n_lines", "n_lines >= 10 AND 10 * n_dup_lines > 3 * n_lines"),
    Rule("word_length", "n_words > 0 AND word_chars >= 3 * n_words AND word_chars <= 10 * n_words", "2 * word_chars < 5 * n_words OR word_chars > 12 * n_words"),
    Rule("one_word", "n_words >= 20 AND 100 * n_top_word <= 15 * n_words", "n_words >= 20 AND 4 * n_top_word > n_words"),
    Rule("sentences", "n_words >= 20 AND 50 * n_ends >= n_words AND 2 * n_ends <= n_words", "n_words >= 60 AND 200 * n_ends < n_words OR 5 * n_ends > 4 * n_words"),
)
#: More rules would make the pattern table large.
MOST_RULES = 10
ROUNDS = 60


def word_ids(text: bytes) -> tuple[np.ndarray, int]:
    """Each word of text as the place of its first occurrence among the distinct words, and how many are distinct."""
    seen: defaultdict[bytes, int] = defaultdict()
    seen.default_factory = seen.__len__
    parts = [np.fromiter(map(seen.__getitem__, words), np.int64, len(words)) for words in terms(text, WORDS)]
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), len(seen)


def repeated(ids: np.ndarray, distinct: int) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    pair = ids[:-1] * distinct + ids[1:]
    if distinct >= 1 << 21:  # three of them would not fit into 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair[:-1] * distinct + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : n - 2 + k] |= twice
    return int(inside.sum())


def counts_of(text: bytes) -> tuple[int, ...]:
    """COUNTS of one text."""
    ids, distinct = word_ids(text)
    without = lambda drop: len(text) - len(text.translate(None, drop))
    seen, n_lines = set(), 0
    for line in io.BytesIO(text):
        line = line[:-1] if line.endswith(b"\n") else line
        if line.strip():
            n_lines += 1
            seen.add(line)
    chars = len(text.translate(None, SPACES + LATER))
    spaced = text.translate(WORDS) + b" "
    ends = sum(spaced.count(end + b" ") for end in ENDS)
    top = int(np.bincount(ids).max()) if len(ids) else 0
    return len(ids), chars, without(SYMBOLS), n_lines - len(seen), repeated(ids, distinct), n_lines, text.count(b"!"), without(UPPER), without(LOWER), top, ends


def _count(text: int, kept: list[int]):
    """Batches' columns at kept, then COUNTS of the column at text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([counts_of(t) for t in texts(batch.column(text))], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), *map(pa.array, rows.T)], [*(batch.schema.names[i] for i in kept), *COUNTS])

    return run


def _with_counts(rows: DataFrame, text: int, kept: list[int]) -> DataFrame:
    prepared(rows.sparkSession)
    fields = [rows.schema[i] for i in kept]
    return rows.mapInArrow(lean(_count(text, kept)), T.StructType([*fields, *(T.StructField(c, T.LongType()) for c in COUNTS)]))


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key and COUNTS of its whole text."""
    return _with_counts(picked(docs, key=key, text=text), 1, [0])


def pattern(rules: tuple[Rule, ...] = RULES) -> Column:
    """The votes of all rules as one number: digits base 3, vote + 1, the first rule lowest."""
    votes = (F.when(F.expr(r.fine), 2).when(F.expr(r.junk), 0).otherwise(1) * F.lit(3**i) for i, r in enumerate(rules))
    return sum(votes, F.lit(0)).cast("int")


#: What is held of a rule before any text is seen: the chance that it says 1 of fine texts, of its own kind of junk, of other junk; and how much of all documents that weighs.
PRIOR_FINE, PRIOR_OWN, PRIOR_OTHER, WEIGH_FINE, WEIGH_JUNK = 0.998, 0.02, 0.8, 1.0, 0.001


@dataclass(frozen=True)
class Model:
    """share: of the classes, fine texts first, then a kind of junk for each rule; chance: that a voting rule (column) says 1 of a text of a class (row)."""

    share: np.ndarray
    chance: np.ndarray

    def classes(self, votes: np.ndarray) -> np.ndarray:
        """Chances of the classes for texts with these votes (rows of -1, 0, 1)."""
        log = np.log(self.share) + (votes > 0) @ np.log(self.chance).T + (votes < 0) @ np.log1p(-self.chance).T
        odds = np.exp(log - log.max(axis=1, keepdims=True))
        return odds / odds.sum(axis=1, keepdims=True)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Chance that a text with these votes is fine."""
        return self.classes(votes)[:, 0]

    def accuracy(self) -> np.ndarray:
        """(chance that a rule's 1 is of a fine text, chance that its -1 is of junk), a row a rule."""
        up, down = self.share[:, None] * self.chance, self.share[:, None] * (1 - self.chance)
        return np.stack([up[0] / up.sum(axis=0), 1 - down[0] / down.sum(axis=0)], axis=1)


def votes_of(patterns: np.ndarray, n_rules: int) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(n_rules) % 3 - 1


def fit(votes: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Expectation-maximisation, from the share of favourable votes as the first posterior. Junk is of many kinds, which fail different rules, so each rule has a kind of
    its own; with one kind of junk for all, passing the rules that most junk fails would outweigh failing the one that tells. Notional texts in proportion to
    the real ones hold the rules to rarely failing fine texts, so the fit is the same at every size."""
    n_rules = votes.shape[1]
    up, down = (votes > 0).astype(float), (votes < 0).astype(float)
    cast, against = up + down, down.sum(axis=1)
    fine = np.where(cast.sum(axis=1) > 0, 1 - against / np.maximum(cast.sum(axis=1), 1), 0.5)
    blame = np.where(against[:, None] > 0, down / np.maximum(against, 1)[:, None], 1 / n_rules)
    classes = np.concatenate([fine[:, None], (1 - fine)[:, None] * blame], axis=1)
    total = max(1, counts.sum())
    prior = np.concatenate([np.full((1, n_rules), PRIOR_FINE), np.where(np.eye(n_rules, dtype=bool), PRIOR_OWN, PRIOR_OTHER)])
    weight = total * np.where(np.arange(n_rules + 1)[:, None] == 0, WEIGH_FINE, WEIGH_JUNK)
    for k in range(rounds + 1):
        mass = counts[:, None] * classes
        share = (mass.sum(axis=0) + total * 1e-6) / (mass.sum() + total * 1e-6 * (n_rules + 1))
        model = Model(share, (mass.T @ up + prior * weight) / (mass.T @ cast + weight))
        if k < rounds:
            classes = model.classes(votes)
    return model


def trained(rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> tuple[Model, DataFrame]:
    """The model of rows (with COUNTS), and its patterns with their posterior: as many rows as there are patterns at most."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    found = sorted(rows.groupBy(pattern(rules).alias("pattern")).count().collect())
    patterns, counts = (np.array([r[k] for r in found], np.int64) for k in (0, 1))
    votes = votes_of(patterns, len(rules))
    model = fit(votes, counts)
    out = [(int(p), float(x)) for p, x in zip(patterns, model.posterior(votes), strict=True)]
    return model, rows.sparkSession.createDataFrame(out, "pattern int, quality double")


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, least: float = 0.5) -> DataFrame:
    """One row a document: key, COUNTS, base_failed, quality (the posterior chance of being fine), kept."""
    rows = table(counted(docs, key, text))
    _, known = trained(rows, rules)
    out = _decided(rows, known, rules, least)
    return out.select(F.col("key").alias(key), *COUNTS, "base_failed", "quality", "kept")


def _decided(rows: DataFrame, known: DataFrame, rules: tuple[Rule, ...], least: float) -> DataFrame:
    """rows with base_failed, quality and kept; known is broadcast: ``3 ** MOST_RULES`` rows at most."""
    out = rows.withColumn("pattern", pattern(rules)).join(F.broadcast(known), "pattern").withColumn("base_failed", F.expr(BASE_FAILS))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))


def cleaned(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, least: float = 0.5) -> DataFrame:
    """docs' rows and columns whose text is kept. The texts are counted twice: once for the fit, once beside their rows, so that no row is sought by a key."""
    names = docs.columns
    plain, at = docs.toDF(*(f"c{i}" for i in range(len(names)))), names.index(text)
    _, known = trained(table(_with_counts(plain.select(f"c{at}"), 0, [])), rules)
    rows = _decided(_with_counts(plain, at, list(range(len(names)))), known, rules, least)
    return rows.where("kept").select(*plain.columns).toDF(*names)
