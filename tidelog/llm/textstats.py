"""Statistics of one text, shared by the quality rules and the quality classifier.

A text is read once: a byte histogram gives every character class, its words are numbered in
order of appearance, and windows of three word numbers show what repeats.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows handled at a time inside an Arrow batch, so that memory follows a few texts only.
SLICE = 128

WHITE = np.array([9, 10, 11, 12, 13, 32])
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words", "mean_word", "max_word", "symbols", "bars", "upper", "digits", "exclaims", "stops", "commas",
    "other_marks", "non_ascii", "white", "lines_per_word", "dup_lines", "repeated", "distinct_words", "top_word",
    "byte_entropy", "longest_run", "edge_words",
)


def repeats(ids: np.ndarray, distinct: int) -> np.ndarray:
    """Which words lie in a window of three words that occurs twice or more."""
    covered = np.zeros(len(ids), bool)
    if len(ids) < 4:
        return covered
    first, second, third = ids[:-2], ids[1:-1], ids[2:]
    if distinct < 1 << 21:
        windows = (first << 42) | (second << 21) | third
    else:
        pairs = np.unique((first << 32) | second, return_inverse=True)[1]
        windows = (pairs.astype(np.int64) << 32) | third
    _, at, times = np.unique(windows, return_inverse=True, return_counts=True)
    often = times[at] > 1
    for shift in range(3):
        covered[shift : shift + len(often)] |= often
    return covered


def describe(text: str | None) -> tuple[list[int], list[float]]:
    """(COUNTS, FEATURES) of a text; a null text counts as the empty one."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    bytes_of = np.frombuffer(raw, np.uint8)
    histogram = np.bincount(bytes_of, minlength=256)
    words = raw.split()
    n_words = len(words)
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    n_repeat = int(repeats(ids, len(number)).sum())
    seen: set[bytes] = set()
    n_lines = n_dup = 0
    for line in raw.split(b"\n"):
        if line.strip():
            n_lines += 1
            if line in seen:
                n_dup += 1
            else:
                seen.add(line)
    white = int(histogram[WHITE].sum())
    word_chars = len(text) - white
    n_symbols = int(histogram[SYMBOLS].sum())
    counts = [n_words, word_chars, n_symbols, n_lines, n_dup, n_repeat]
    if not n_words:
        return counts, [0.0] * len(FEATURES)

    def of(chars: bytes) -> int:
        return int(histogram[np.frombuffer(chars, np.uint8)].sum())

    letters = max(1, word_chars)
    upper, digits = int(histogram[65:91].sum()), int(histogram[48:58].sum())
    lengths = np.fromiter(map(len, words), np.int64, n_words)
    share = histogram[histogram > 0] / len(raw)
    turns = np.flatnonzero(np.diff(bytes_of))
    runs = np.diff(np.concatenate(([-1], turns, [len(raw) - 1])))
    marked = sum(not (w[-1:].isalnum() or w[-1] > 127 or w[-1:] in b".,") for w in number)
    features = [
        np.log1p(n_words),
        word_chars / n_words,
        np.log1p(int(lengths.max())),
        n_symbols / letters,
        of(b"|") / letters,
        upper / letters,
        digits / letters,
        of(b"!") / letters,
        of(b".") / letters,
        of(b",") / letters,
        (of(b"\"'()-/:;=?@[\\]^_`{}~+")) / letters,
        int(histogram[128:].sum()) / len(raw),
        white / len(text),
        n_lines / n_words,
        n_dup / n_lines,
        n_repeat / n_words,
        len(number) / n_words,
        int(np.bincount(ids).max()) / n_words,
        float(-(share * np.log2(share)).sum()),
        np.log1p(int(runs.max())),
        marked / len(number),
    ]
    return counts, features


def with_statistics(
    docs: DataFrame,
    text_col: str,
    carry: list[str],
    *,
    counts: bool = False,
    features: bool = False,
    score: tuple[str, Callable[[np.ndarray], np.ndarray]] | None = None,
) -> DataFrame:
    """The ``carry`` columns, with one long per count, an array ``features`` of doubles, or a
    double that a function makes of the rows of features. The text goes to Python once."""
    types = dict(docs.dtypes)
    source = docs.select(*dict.fromkeys([*carry, text_col]))
    names = [*carry, *(COUNTS if counts else ()), *(["features"] if features else []), *([score[0]] if score else [])]
    kinds = [types[c] for c in carry] + ["long"] * (counts and len(COUNTS)) + ["array<double>"] * features + ["double"] * bool(score)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                found = [describe(t.as_py()) for t in part.column(text_col)]
                out = [part.column(c) for c in carry]
                if counts:
                    out += [pa.array([c[k] for c, _ in found], pa.int64()) for k in range(len(COUNTS))]
                if features:
                    out.append(pa.array([f for _, f in found], pa.list_(pa.float64())))
                if score:
                    out.append(pa.array(score[1](np.array([f for _, f in found], np.float64)), pa.float64()))
                yield pa.RecordBatch.from_arrays(out, names)

    return source.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))
