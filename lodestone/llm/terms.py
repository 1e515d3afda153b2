"""Terms and words of whole texts, from their UTF-8 bytes, a piece at a time.

A letter is any character outside ASCII or an ASCII letter; only A-Z are lower-cased. A word is what ASCII whitespace separates.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Bytes of a text that are in Python's own objects at a time, up to the end of a term.
PIECE = 1 << 20
SPACES = bytes([32, *range(9, 14)])


def _table(kept: bytes) -> bytes:
    own = set(kept) | set(kept.upper()) | set(range(128, 256))
    return bytes(b + 32 if 65 <= b <= 90 else b if b in own else 32 for b in range(256))


_LETTERS = b"abcdefghijklmnopqrstuvwxyz"
#: Letters alone; letters and digits; everything but whitespace, as it is.
LETTERS, ALPHANUMERIC = _table(_LETTERS), _table(_LETTERS + b"0123456789")
WORDS = bytes(32 if b in SPACES else b for b in range(256))


def texts(column: pa.Array) -> Iterator[bytes]:
    """The texts of a string column, one at a time; nulls are empty."""
    for x in column.cast(pa.large_binary()):
        yield x.as_py() or b""


def terms(text: bytes, table: bytes) -> Iterator[list[bytes]]:
    """All terms of text in order, in lists of about PIECE bytes."""
    text = text.translate(table)
    start = 0
    while start < len(text):
        end = text.find(b" ", start + PIECE) if start + PIECE < len(text) else len(text)
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end
