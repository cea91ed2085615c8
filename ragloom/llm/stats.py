"""Counts over one text, shared by the quality operators.

Words are runs of bytes other than ASCII white space (``bytes.split``), so the
work is on UTF-8 bytes; characters are code points."""

from __future__ import annotations

import numpy as np

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\r\x0b\x0c"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = b"0123456789"
PUNCTUATION = b".,;:!?\"'()-"
CONTINUATION = bytes(range(0x80, 0xC0))

FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
          "n_lines", "n_upper", "n_digits", "n_punctuation", "n_types", "n_bars", "longest")


def _without(text: bytes, drop: bytes) -> int:
    return len(text) - len(text.translate(None, drop))


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words that lie in some ``width``-word window found at least twice (exact:
    windows are ranked by doubling, never hashed; ``width`` is a power of two)."""
    n = len(words)
    if n <= width:
        return 0
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    step = 1
    while step < width:
        code = rank[:-step] * (int(rank.max()) + 1) + rank[step:]
        seen, rank, times = np.unique(code, return_inverse=True, return_counts=True)
        if len(seen) == len(code):
            return 0
        step *= 2
    twice = (times[rank] > 1).astype(np.int64)
    cover = np.zeros(n + 1, np.int64)
    cover[:len(twice)] += twice
    cover[width:width + len(twice)] -= twice
    return int((np.cumsum(cover[:n]) > 0).sum())


def text_stats(text: bytes) -> tuple[int, ...]:
    """The values of ``FIELDS`` for one text."""
    words = text.split()
    if not words:
        return (0, 0, _without(text, SYMBOLS), 0, 0, 0, 0, 0, 0, 0, 0, 0)
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)] if b"\n" in text else [text]
    return (len(words), len(text) - _without(text, SPACE + CONTINUATION),
            _without(text, SYMBOLS), len(lines) - len(set(lines)), repeated_words(words),
            len(lines), _without(text, UPPER), _without(text, DIGITS),
            _without(text, PUNCTUATION), len(set(words)), text.count(b"|"),
            max(map(len, words)))
