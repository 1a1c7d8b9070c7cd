"""Counts of whole texts that quality rules and the quality classifier share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from graphloom.llm.textbatch import IS_SPACE, TextBatch, chunks, later_copies, repeated, windows

WINDOW = 8
SYMBOLS = "#*$%&|<>"

_bytes = np.arange(256)
_lead = (_bytes & 0xC0) != 0x80
_CHAR = _lead & ~IS_SPACE
_SYMBOL = np.isin(_bytes, [ord(c) for c in SYMBOLS])
_UPPER = (_bytes >= 65) & (_bytes <= 90)
_LOWER = (_bytes >= 97) & (_bytes <= 122)
_DIGIT = (_bytes >= 48) & (_bytes <= 57)
_BANG = np.isin(_bytes, [ord("!"), ord("?")])
_STOP = np.isin(_bytes, [ord("."), ord(","), ord(";"), ord(":")])
_PIPE = _bytes == ord("|")
_HIGH = _bytes >= 0xC0

_CLASSES = {"word_chars": _CHAR, "n_symbols": _SYMBOL, "n_upper": _UPPER, "n_lower": _LOWER, "n_digits": _DIGIT, "n_bangs": _BANG, "n_stops": _STOP, "n_pipes": _PIPE, "n_accents": _HIGH}
_TABLES = np.stack(list(_CLASSES.values()), axis=1).astype(np.int64)

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_digits", "n_bangs", "n_stops", "n_pipes", "n_accents", "n_short", "n_long", "n_distinct")


def _one(array: pa.Array) -> dict[str, np.ndarray]:
    b = TextBatch(array)
    n = b.n
    start, end = b.words()
    own = b.owner(start)
    h = b.hashes(start, end)
    out = {"n_words": np.bincount(own, minlength=n)}
    seen = np.zeros((n, 256), np.int64)
    for i in range(n):
        seen[i] = np.bincount(b.data[b.begin[i] : b.end[i]], minlength=256)
    for name, column in zip(_CLASSES, (seen @ _TABLES).T):
        out[name] = column
    size = end - start
    out["n_short"] = np.bincount(own[size <= 2], minlength=n)
    out["n_long"] = np.bincount(own[size >= 14], minlength=n)
    out["n_distinct"] = out["n_words"] - np.bincount(own[later_copies(h, own)], minlength=n)
    line_end = np.flatnonzero(b.data == 10)
    line_start = np.concatenate([[0], line_end[:-1] + 1])
    has_word = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_start, line_end = line_start[has_word], line_end[has_word]
    line_own = b.owner(line_start)
    out["n_lines"] = np.bincount(line_own, minlength=n)
    out["n_dup_lines"] = np.bincount(line_own[later_copies(b.hashes(line_start, line_end), line_own)], minlength=n)
    w, at = windows(h, own, WINDOW)
    at = at[repeated(w, own[at])]
    cover = np.bincount(at, minlength=len(h) + 1) - np.bincount(at + WINDOW, minlength=len(h) + 1)
    covered = np.cumsum(cover)[:-1] > 0
    out["n_repeat_words"] = np.bincount(own[covered], minlength=n)
    return out


def text_stats(array: pa.Array) -> dict[str, np.ndarray]:
    """Whole-text counts by NAMES, as int64; null counts as empty."""
    parts = [_one(a) for _, a in chunks(array)]
    return {k: np.concatenate([p[k] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for k in NAMES}
