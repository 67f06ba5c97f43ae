"""Snippets: the window of a text that holds most distinct phrases, the earliest on a tie, with hits marked."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.porter import stem
from quarry.session import ship

_TOKEN = re.compile(r"[^\W_]+")
OPEN, CLOSE, MORE = "«", "»", "…"


def _form(word: str, stemmed: bool) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFD", word.lower()) if unicodedata.category(c) != "Mn")
    return stem(plain) if stemmed else plain


def best_start(hits: list[tuple[int, int, int]], length: int, size: int) -> int:
    """Where the window of ``size`` of ``length`` tokens begins that holds most distinct phrases of (begin, end, phrase), the earliest of equal ones.

    Windows begin at a hit, at 0 or at the last place. Both ends of the window only move on, so each hit enters and leaves once.
    """
    by_begin, by_end = sorted(hits), sorted(hits, key=lambda h: (h[1], h[0]))
    held: dict[int, int] = {}
    best, start, into, out = -1, 0, 0, 0
    for i in sorted({min(h[0], length - size) for h in hits} | {0}):
        while into < len(by_end) and by_end[into][1] <= i + size:
            held[by_end[into][2]] = held.get(by_end[into][2], 0) + 1
            into += 1
        while out < len(by_begin) and by_begin[out][0] < i and by_begin[out][1] <= i + size:
            k = by_begin[out][2]
            held[k] -= 1
            if not held[k]:
                del held[k]
            out += 1
        if len(held) > best:
            best, start = len(held), i
    return start


def snippet_of(text: str, phrases: list[list[str]], size: int, stemmed: bool = True) -> str:
    """At most ``size`` tokens of ``text``; shorter texts come whole. Phrases are lists of words."""
    at = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    forms = [_form(text[a:b], stemmed) for a, b in at]
    want = [[_form(w, stemmed) for w in p] for p in phrases]
    hits = [(i, i + len(p), k) for k, p in enumerate(want) for i in range(len(forms) - len(p) + 1) if p and forms[i : i + len(p)] == p]
    start = best_start(hits, len(at), size) if len(at) > size and hits else 0
    stop = min(len(at), start + size)
    if not at:
        return text
    lo = 0 if start == 0 else at[start][0]
    hi = len(text) if stop == len(at) else at[stop - 1][1]
    out, pos = [], lo
    done = start
    for a, b, _ in sorted(hits):
        if a >= done and b <= stop:
            out += [text[pos : at[a][0]], OPEN, text[at[a][0] : at[b - 1][1]], CLOSE]
            pos, done = at[b - 1][1], b
    return (MORE if lo else "") + "".join(out) + text[pos:hi] + (MORE if hi < len(text) else "")


def snippet(text: Column, phrases: list[list[str]], size: int = 12, stemmed: bool = True) -> Column:
    @F.pandas_udf("string")
    def cut(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda t: None if t is None else snippet_of(t, phrases, size, stemmed))

    ship()
    return cut(text)
