"""Words, lines and windows of many texts at once, as numpy arrays over their bytes.

A word is a run of bytes other than space and 0x09-0x0D, so words never span
documents. Nothing here makes a Python object per word. Work goes through in
portions of about a megabyte; a single longer text is hashed in parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PORTION = 1 << 20
_U = np.uint64

_rng = np.random.default_rng(20250611)
_BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_STEP = _U(0x9E3779B97F4A7C15)
_WINDOW_STEPS = _rng.integers(1, 2**63, 16, dtype=np.uint64) * _U(2) + _U(1)

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_WORD_VALUES = _BYTE_VALUES.copy()
_WORD_VALUES[_IS_SPACE] = 0
_FOLDED_VALUES = _WORD_VALUES.copy()
_FOLDED_VALUES[ord("A") : ord("Z") + 1] = _WORD_VALUES[ord("a") : ord("z") + 1]
_LINE_VALUES = _BYTE_VALUES.copy()
_LINE_VALUES[0x0A] = 0


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit of the input moves every bit of the result."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@dataclass
class Texts:
    """Some texts as one byte array: text i is ``data[bounds[i]:bounds[i + 1]]``."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1


def portions(column: pa.Array, size: int = PORTION) -> Iterator[Texts]:
    """Cut a string column into portions of whole texts; null counts as empty."""
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    row, n = 0, len(column)
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        lo, hi = offsets[row], offsets[end]
        yield Texts(row, data[lo:hi], offsets[row : end + 1] - lo)
        row = end


def _segment_hashes(data: np.ndarray, starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """One hash per segment [starts[i], starts[i + 1]); bytes whose value is 0 do not count."""
    out = np.empty(len(starts), np.uint64)
    stops = np.append(starts[1:], len(data))
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(stops, starts[i] + PORTION, "right")))
        lo, hi = int(starts[i]), int(stops[j - 1])
        if j == i + 1 and hi - lo > PORTION:  # one very long segment, in parts
            total, power = np.zeros(1, np.uint64), np.ones(1, np.uint64)  # arrays: they wrap silently
            for p in range(lo, hi, PORTION):
                part = values[data[p : min(hi, p + PORTION)]]
                steps = np.cumprod(np.concatenate((power, np.full(len(part) - 1, _STEP))))
                total, power = total + (part * steps).sum(dtype=np.uint64), steps[-1:] * _STEP
            out[i] = total[0]
        else:
            local = (starts[i:j] - lo).astype(np.int64)
            sizes = np.diff(np.append(local, hi - lo))
            place = np.arange(hi - lo) - np.repeat(local, sizes)
            steps = np.full(int(sizes.max()), _STEP)
            steps[0] = 1
            out[i:j] = np.add.reduceat(values[data[lo:hi]] * np.cumprod(steps)[place], local)
        i = j
    return mix(out)


@dataclass
class Words:
    """Words of a portion; those of text i are ``bounds[i]:bounds[i + 1]``."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def words(texts: Texts, fold: bool = False) -> Words:
    """All words with a hash each; ``fold`` lower-cases A-Z."""
    data, bounds = texts.data, texts.bounds
    inside = ~_IS_SPACE[data]
    before = np.zeros_like(inside)
    before[1:] = inside[:-1]
    before[bounds[:-1][bounds[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros_like(inside)
    after[:-1] = inside[1:]
    last = bounds[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    hashes = _segment_hashes(data, starts, _FOLDED_VALUES if fold else _WORD_VALUES) if len(starts) else np.zeros(0, np.uint64)
    return Words(starts, ends, np.searchsorted(starts, bounds), hashes)


def windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of all runs of ``size`` words inside one text."""
    n = len(w.hashes)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = w.hashes[: n - size + 1] * _WINDOW_STEPS[0]
    for k in range(1, size):
        total = total + w.hashes[k : n - size + 1 + k] * _WINDOW_STEPS[k]
    left = np.repeat(w.bounds[1:], w.counts)[: n - size + 1]
    at = np.flatnonzero(np.arange(n - size + 1) + size <= left)
    return at, mix(total[at] + _U(size))


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each text."""
    run = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, dtype=np.int64, out=run[1:])
    return run[bounds[1:]] - run[bounds[:-1]]


def repeats(keys: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags: the key stands elsewhere in the same text too; all but one of its places there."""
    own = mix(keys ^ mix(text_of.astype(np.uint64) + _STEP))
    order = np.argsort(own)
    ranked = own[order]
    same = ranked[1:] == ranked[:-1]
    again, more = np.zeros(len(own), bool), np.zeros(len(own), bool)
    again[order[1:]] = same
    more[order[1:]] |= same
    more[order[:-1]] |= same
    return more, again


def lines(texts: Texts, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and "holds a word" of every line; lines end at 0x0A only."""
    data, bounds = texts.data, texts.bounds
    breaks = np.flatnonzero(data == 0x0A) + 1
    starts = np.unique(np.concatenate((bounds[:-1][np.diff(bounds) > 0], breaks[breaks < len(data)])))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    text_of = np.searchsorted(bounds, starts, "right") - 1
    stops = np.append(starts[1:], len(data))
    filled = np.searchsorted(w.starts, stops) > np.searchsorted(w.starts, starts)
    # A break at the end of a text starts no line of the next one: such starts are that text's own.
    return text_of, _segment_hashes(data, starts, _LINE_VALUES), filled


@dataclass
class Statistics:
    """Whole-text counts of a portion, one entry per text."""

    n_bytes: np.ndarray
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_lines: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    n_distinct_words: np.ndarray
    n_upper: np.ndarray
    n_digits: np.ndarray
    n_marks: np.ndarray
    n_beyond_ascii: np.ndarray
    longest_word: np.ndarray
    n_long_words: np.ndarray
    n_shout: np.ndarray


def _class_of(*spans: str) -> np.ndarray:
    flags = np.zeros(256, bool)
    for s in spans:
        flags[[ord(c) for c in s]] = True
    return flags


_SYMBOLS = _class_of("#*$%&|<>")
_UPPER = _class_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGITS = _class_of("0123456789")
_MARKS = _class_of("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_STARTS_CHAR = (np.arange(256) & 0xC0) != 0x80
_BEYOND = (np.arange(256) >= 0xC0)


def statistics(texts: Texts, window: int = 5) -> Statistics:
    """Counts over whole texts; an empty text has zeros everywhere."""
    data, bounds = texts.data, texts.bounds
    w = words(texts)
    text_of = w.text_of
    at, keys = windows(w, window)
    more, _ = repeats(keys, text_of[at])
    covered = np.zeros(len(w.hashes) + 1, np.int64)
    np.add.at(covered, at[more], 1)
    np.add.at(covered, at[more] + window, -1)
    in_repeat = np.cumsum(covered[:-1]) > 0
    line_text, line_keys, filled = lines(texts, w)
    _, line_again = repeats(line_keys[filled], line_text[filled])
    _, word_again = repeats(w.hashes, text_of)
    sizes = w.ends - w.starts
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, text_of, sizes)
    upper = _UPPER[data]
    run = np.concatenate(([0], np.cumsum(upper, dtype=np.int64)))
    shout = (run[w.ends] - run[w.starts]) * 2 > sizes
    n = len(texts)
    return Statistics(
        n_bytes=np.diff(bounds),
        n_words=w.counts.astype(np.int64),
        word_chars=per_text(_STARTS_CHAR[data] & ~_IS_SPACE[data], bounds),
        n_symbols=per_text(_SYMBOLS[data], bounds),
        n_lines=np.bincount(line_text[filled], minlength=n),
        n_dup_lines=np.bincount(line_text[filled][line_again], minlength=n),
        n_repeat_words=per_text(in_repeat, w.bounds),
        n_distinct_words=w.counts - per_text(word_again, w.bounds),
        n_upper=per_text(upper, bounds),
        n_digits=per_text(_DIGITS[data], bounds),
        n_marks=per_text(_MARKS[data], bounds),
        n_beyond_ascii=per_text(_BEYOND[data], bounds),
        longest_word=longest,
        n_long_words=per_text(sizes > 12, w.bounds),
        n_shout=per_text(shout & (sizes > 2), w.bounds),
    )
