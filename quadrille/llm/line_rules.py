"""Quality rules from line labels (operator 3).

A linear-chain conditional random field over the lines of a text says which are content and which boilerplate; Viterbi decoding finds the
likeliest labelling, and the share of words in content lines decides whether the text stays. Base statistics of the text are reported
beside it, and two plain rules come first.

The field is fitted by maximum likelihood on a bounded sample of labelled texts: the lines of good texts are content,
those of bad texts boilerplate. Whole texts have one label throughout and say nothing of changes, so as many chains again are spliced: runs of lines of a good
text and of a bad one by turns. From these the field learns what a line looks like beside the other kind, and how often the label changes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, ship, utf8
from .surface import LINE_FEATURES, SYMBOLS, line_features, repeated_words

FIT_ROWS = 4000
FIT_CHARS = 100_000
FIT_LINES = 48
FIT_CHAINS = 4000
#: Longest run of lines of one kind in a spliced chain.
FIT_RUN = 8
LEAST_WORDS = 50
MOST_REPEATED = 50
LEAST_CONTENT = 0.5
_CHUNK = 8192
#: Bytes that start no code point, and white space.
_NOT_WORD_CHARS = bytes(range(0x80, 0xC0)) + b" \t\n\x0b\x0c\r"


@dataclass
class LineField:
    """Scores of boilerplate (1) against content (0): a weight a feature, and what a label scores after another."""

    weights: np.ndarray
    bias: float
    start: np.ndarray
    step: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return ((features - self.mean) / self.scale) @ self.weights + self.bias

    def decode(self, scores: list[float]) -> bytearray:
        """The likeliest labels (Viterbi) for boilerplate scores of a chain of lines; ties go to content."""
        (s00, s01), (s10, s11) = self.step.tolist()
        a, b = self.start.tolist()
        from0, from1 = bytearray(len(scores)), bytearray(len(scores))
        for i, e in enumerate(scores):
            if i:
                a0, a1, b0, b1 = a + s00, b + s10, a + s01, b + s11
                from0[i], from1[i] = a1 > a0, b1 > b0
                a, b = (a1 if a1 > a0 else a0), (b1 if b1 > b0 else b0)
            b += e
        labels = bytearray(len(scores))
        if scores:
            labels[-1] = b > a
            for i in range(len(scores) - 1, 0, -1):
                labels[i - 1] = from1[i] if labels[i] else from0[i]
        return labels


def word_lines(text: bytes) -> Iterator[tuple[bytes, int, bool]]:
    """(line, words, whether an earlier line equals it) of the lines that have a word."""
    seen: set[bytes] = set()
    for line in text.split(b"\n"):
        if n := len(line.split()):
            yield line, n, line in seen
            seen.add(line)


def spliced(good: list[list], bad: list[list], rng: np.random.Generator, longest: int = FIT_LINES, run: int = FIT_RUN) -> tuple[list, list[int]]:
    """(rows, labels) of a chain that takes runs of lines of a good and of a bad text by turns, each text in its own order."""
    texts, at, rows, labels = (good[rng.integers(len(good))], bad[rng.integers(len(bad))]), [0, 0], [], []
    label = int(rng.integers(2))
    while at[label] < len(texts[label]) and len(rows) < longest:
        taken = texts[label][at[label] : at[label] + int(rng.integers(1, run + 1))][: longest - len(rows)]
        rows += taken
        labels += [label] * len(taken)
        at[label] += len(taken)
        label = 1 - label
    return rows, labels


def fit_field(sample: list[tuple[str, int]], rounds: int = 120, rate: float = 0.1, l2: float = 1e-3, seed: int = 7) -> LineField:
    """Maximum likelihood by forward-backward and Adam over at most FIT_CHAINS chains of FIT_LINES lines, and as many spliced ones. Without both kinds of text, all lines are content."""
    rng = np.random.default_rng(seed)
    chains: list[tuple[list[list[float]], list[int]]] = []
    texts: tuple[list, list] = ([], [])
    for text, good in sample:
        rows = [line_features(*x) for x in word_lines(text.encode())]
        if rows:
            texts[1 - good].append(rows)
        chains += [(part, [1 - good] * len(part)) for i in range(0, len(rows), FIT_LINES) if (part := rows[i : i + FIT_LINES])]
    d = len(LINE_FEATURES)
    if not texts[0] or not texts[1]:
        return LineField(np.zeros(d), -1.0, np.zeros(2), np.zeros((2, 2)), np.zeros(d), np.ones(d))
    if len(chains) > FIT_CHAINS:
        chains = [chains[i] for i in np.sort(rng.choice(len(chains), FIT_CHAINS, replace=False))]
    chains += [spliced(*texts, rng) for _ in chains]
    n, longest = len(chains), max(len(c) for c, _ in chains)
    x, live, y = np.zeros((n, longest, d)), np.zeros((n, longest), bool), np.zeros((n, longest), int)
    for i, (c, labels) in enumerate(chains):
        x[i, : len(c)], live[i, : len(c)], y[i, : len(c)] = c, True, labels
    mean, scale = x[live].mean(0), x[live].std(0)
    scale[scale < 1e-9] = 1
    x = np.where(live[:, :, None], (x - mean) / scale, 0)
    theta = np.zeros(d + 1 + 2 + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    ends = live.sum(1) - 1
    pairs = np.bincount((2 * y[:, :-1] + y[:, 1:])[live[:, 1:]], minlength=4)
    want = np.concatenate([(x * y[:, :, None]).sum((0, 1)), [y.sum()], [(y[:, 0] == 0).sum(), (y[:, 0] == 1).sum()], pairs])
    lse = lambda a, axis: np.log(np.exp(a - (top := a.max(axis, keepdims=True))).sum(axis)) + top.squeeze(axis)
    for t in range(1, rounds + 1):
        w, b, start, step = theta[:d], theta[d], theta[d + 1 : d + 3], theta[d + 3 :].reshape(2, 2)
        e = np.stack([np.zeros((n, longest)), x @ w + b], 2) * live[:, :, None]
        fore, back = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        fore[:, 0] = start + e[:, 0]
        for k in range(1, longest):
            fore[:, k] = np.where(live[:, k, None], lse(fore[:, k - 1, :, None] + step, 1) + e[:, k], fore[:, k - 1])
        for k in range(longest - 2, -1, -1):
            back[:, k] = np.where(live[:, k + 1, None], lse(step + (e[:, k + 1] + back[:, k + 1])[:, None, :], 2), 0)
        z = lse(fore[np.arange(n), ends], 1)
        p = np.exp(fore + back - z[:, None, None]) * live[:, :, None]
        pair = np.exp(fore[:, :-1, :, None] + step + (e[:, 1:] + back[:, 1:])[:, :, None, :] - z[:, None, None, None]) * live[:, 1:, None, None]
        got = np.concatenate([(x * p[:, :, 1:]).sum((0, 1)), [p[:, :, 1].sum()], p[:, 0].sum(0), pair.sum((0, 1)).ravel()])
        grad = (want - got) / live.sum() - l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return LineField(theta[:d], float(theta[d]), theta[d + 1 : d + 3], theta[d + 3 :].reshape(2, 2), mean, scale)


def judge(text: bytes, field: LineField) -> dict:
    """Base statistics, words in content lines and the verdict for one text."""
    words = text.split()
    out = {"n_words": len(words), "word_chars": len(text.translate(None, _NOT_WORD_CHARS)), "n_symbols": len(text) - len(text.translate(None, SYMBOLS)), "n_repeat_words": repeated_words(words)}
    scores: list[float] = []
    counts: list[int] = []
    chunk: list[list[float]] = []
    repeats = 0
    for line, n, again in word_lines(text):
        repeats += again
        counts.append(n)
        chunk.append(line_features(line, n, again))
        if len(chunk) == _CHUNK:
            scores += field.emissions(np.array(chunk)).tolist()
            chunk = []
    if chunk:
        scores += field.emissions(np.array(chunk)).tolist()
    labels = field.decode(scores)
    content = sum(n for n, y in zip(counts, labels, strict=True) if not y)
    share = content / len(words) if words else 0.0
    failed = len(words) < LEAST_WORDS or 100 * out["n_repeat_words"] > MOST_REPEATED * len(words)
    return out | {"n_dup_lines": repeats, "base_failed": failed, "n_lines": len(counts), "n_content_lines": len(counts) - sum(labels), "content_share": share, "kept": not failed and share >= LEAST_CONTENT}


def judge_documents(docs: DataFrame, labels: DataFrame, max_rows: int = FIT_ROWS, max_chars: int = FIT_CHARS) -> DataFrame:
    """A row of statistics and the verdict for every row of ``docs``.

    Words are runs of anything but ASCII white space. A null or empty text has no words and fails the base rules. Lines without a word
    are not labelled. Rows that repeat get equal rows; an empty table gives no rows; other columns are ignored.
    """
    import pyarrow as pa

    ship(docs.sparkSession)
    field = fit_field(labelled_sample(docs, labels, "quality", max_rows, max_chars))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_content_lines", "content_share", "kept"]
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(at, 256) for x in batches for at in range(0, x.num_rows, 256)):
            rows = [judge(t.as_py() or b"", field) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds, strict=True)]], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long"), utf8("text").alias("text")).mapInArrow(
        run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_lines long, n_content_lines long, content_share double, kept boolean"
    )
