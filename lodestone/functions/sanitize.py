"""Blanking comments and literals of source text, with offsets and lines kept.

Each language is one scanner pattern: what it matches is blanked (all but line ends), what it passes over stays. Nested comments and
raw strings, whose ends no plain pattern finds, are closed by a second search.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STRING = r'"(?:\\[\s\S]|[^"\\])*(?:"|\\?\Z)'
_SINGLE = r"'(?:\\[\s\S]|[^'\\])*(?:'|\\?\Z)"
_LINE, _BLOCK = r"//[^\n]*", r"/\*[\s\S]*?(?:\*/|\Z)"
SCANNERS = {
    "rust": re.compile(rf"""{_LINE}|(?P<nested>/\*)|r(?P<raw>\#*)"|{_STRING}|'\\(?:\\[\s\S]|[^'\\])*?(?:\\[\s\S]|[^'\\])*'|'[^\n']'|'\\[\s\S]'"""),
    "python": re.compile(r'''#[^\n]*|"""[\s\S]*?(?:"""|\Z)|\'\'\'[\s\S]*?(?:\'\'\'|\Z)|"(?:\\[\s\S]|[^"\\\n])*(?:"|(?=\n)|\\?\Z)|'(?:\\[\s\S]|[^'\\\n])*(?:'|(?=\n)|\\?\Z)'''),
    "js": re.compile(rf"(?P<kept>{_STRING}|{_SINGLE})|{_LINE}|{_BLOCK}|`(?:\\[\s\S]|[^`\\])*(?:`|\\?\Z)"),
}
_NESTED = re.compile(r"/\*|\*/")


def blanked(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def sanitize(language: str, text: str) -> str:
    scanner = SCANNERS.get(language)
    if scanner is None:
        return text
    out, at = [], 0
    while m := scanner.search(text, at):
        end, groups = m.end(), m.groupdict()
        if groups.get("nested"):
            depth, end = 1, len(text)
            for mark in _NESTED.finditer(text, m.end()):
                depth += 1 if mark[0] == "/*" else -1
                if not depth:
                    end = mark.end()
                    break
        elif groups.get("raw") is not None:
            close = text.find('"' + groups["raw"], m.end())
            end = len(text) if close < 0 else close + 1 + len(groups["raw"])
        kept = groups.get("kept") is not None
        out += [text[at : m.start()], text[m.start() : end] if kept else blanked(text[m.start() : end])]
        at = max(end, m.start() + 1)
    return "".join(out) + text[at:]


@F.pandas_udf(T.StringType())
def sanitized(language: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else sanitize(lang, t) for lang, t in zip(language, text, strict=True)])
