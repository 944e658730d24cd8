"""Surface statistics of UTF-8 text, from byte counts that run in C. Shared by the quality classifier and the line labeller."""

from __future__ import annotations

import math

SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_STOPS = b".,;:"
LINE_FEATURES = ("symbols", "bangs", "upper", "digits", "stops", "long_words", "log_words", "bare_end", "repeated")
TEXT_FEATURES = ("symbols", "bangs", "upper", "digits", "stops", "long_words", "log_words", "repeat_lines", "repeat_words", "distinct")


def _rates(b: bytes, words: int) -> list[float]:
    n = len(b)
    each = 1.0 / max(words, 1)
    return [
        min(3.0, (n - len(b.translate(None, SYMBOLS))) * each), min(3.0, b.count(b"!") * each), (n - len(b.translate(None, _UPPER))) / max(n, 1),
        (n - len(b.translate(None, _DIGITS))) / max(n, 1), min(1.0, (n - len(b.translate(None, _STOPS))) * each), min(30.0, n * each) / 10, math.log1p(words) / 5,
    ]


def line_features(line: bytes, words: int, repeated: bool) -> list[float]:
    """LINE_FEATURES of a line with ``words`` words; ``repeated``: an earlier line of the text equals it."""
    return [*_rates(line, words), float(line.rstrip()[-1:] not in (b".", b"!", b"?", b":", b'"')), float(repeated)]


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words within windows of ``window`` words that occur twice or more in the text, first occurrences included."""
    import numpy as np

    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    grams = ids[:n].copy()
    base = len(number) + 1
    exact = base**window < 2**62
    for k in range(1, window):
        grams = grams * base + ids[k : k + n]
    if exact:
        _, at, counts = np.unique(grams, return_inverse=True, return_counts=True)
    else:  # too many spellings for one number: compare the windows themselves
        _, at, counts = np.unique(np.stack([ids[k : k + n] for k in range(window)], 1), axis=0, return_inverse=True, return_counts=True)
        at = at.ravel()
    hit = np.flatnonzero(counts[at] > 1)
    covered = np.zeros(len(words), bool)
    for k in range(window):
        covered[hit + k] = True
    return int(covered.sum())


def text_features(b: bytes) -> list[float]:
    """TEXT_FEATURES of a whole text."""
    words = b.split()
    lines = [x for x in b.split(b"\n") if x.split()]
    return [
        *_rates(b, len(words)), (len(lines) - len(set(lines))) / max(len(lines), 1), repeated_words(words) / max(len(words), 1),
        len(set(words)) / max(len(words), 1),
    ]
