"""Token ids of whole texts by the tokenizers library, with work shared between equal words.

The word tokenizer drops white space and never merges across it, so a text's ids
are the ids of its white-space separated words in a row. Each distinct word goes
through the library once per dictionary; a text is then a row of dictionary
codes. A word is known by a 64-bit hash, and every use is checked against its
length and byte sum; a text in which that check fails, or with characters other
than ASCII and Latin-1 letters, or with the text of a special token, goes through
the library whole.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from tallywake.llm.words import Texts, per_text, portions, words

#: Words a dictionary holds before it starts anew: about 50 MB.
DICTIONARY_WORDS = 1_000_000
#: Bytes of text that share one look-up.
ROUND_BYTES = 1 << 20
_JOINED = 1000
_MARKS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum())

# Plain texts hold ASCII without most control characters, and the letters U+00C0-U+00FF:
# lower-casing them is the same everywhere and normal forms leave them alone.
_ODD = np.ones(256, bool)
_ODD[0x20:0x7F] = False
_ODD[0x09:0x0E] = False
_ODD[0x80:0xC0] = False
_ODD[0xC3] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already has a task on each core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class IdTable:
    """Ids of byte strings, known by hash and checked by length and byte sum; bounded in entries.

    ``make`` gives the ids of new strings in a row and the size of each.
    """

    def __init__(self, make: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int) -> None:
        self.make, self.most = make, most
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted; the other columns are in the same order
        self.checks = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _learn(self, keys: np.ndarray, checks: np.ndarray, new: list[bytes]) -> None:
        flat, sizes = self.make(new)
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate((self.flat[: self.used], np.zeros(max(len(flat), self.used), np.uint32)))
        self.flat[self.used : self.used + len(flat)] = flat
        starts = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.checks = np.insert(self.checks, at, checks)
        self.starts = np.insert(self.starts, at, starts)
        self.sizes = np.insert(self.sizes, at, sizes)

    def places(self, data: np.ndarray, hashes: np.ndarray, checks: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each string ``data[starts[i]:ends[i]]`` in the columns, and whether its check fails there."""
        if not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, bool)
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        known = np.isin(keys, self.keys, assume_unique=True)
        if len(self.keys) + len(keys) - known.sum() > self.most:
            self.clear()
            known[:] = False
        if not known.all():
            new, raw = first[~known], data.tobytes()
            self._learn(keys[~known], checks[new], [raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())])
        at = np.searchsorted(self.keys, keys)[inverse]
        return at, self.checks[at] != checks


class WordPieces:
    """Ids of texts under a tokenizer with word ends that lower-cases and drops white space."""

    def __init__(self, path: str, most_words: int = DICTIONARY_WORDS) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = load(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        end = self.tokenizer.model.end_of_word_suffix
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.ends_word[i] = token.endswith(end)
        # Stems are lower case and normal already: the same model without the normalizer.
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.table = IdTable(self._ids_of, most_words)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [ids for part in _slices(texts, _JOINED) for ids in _encoded(self.tokenizer, part)]

    def _stems(self, stems: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all stems in a row, and where each ends."""
        ids = [_encoded(self.bare, [" ".join(part)])[0] for part in _slices(stems, _JOINED)]
        flat = np.concatenate([np.zeros(0, np.uint32), *ids])
        return flat, np.flatnonzero(self.ends_word[flat]) + 1

    def _ids_of(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and the size of each: a stem of letters, then marks; or the whole word."""
        stems: dict[str, int] = {}
        tails: dict[str, int] = {"": 0}
        stem_no, tail_no = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        for i, word in enumerate([w.decode().lower() for w in new]):
            stem = word.rstrip(_MARKS)
            if stem.isalpha():
                stem_no[i] = stems.setdefault(stem, len(stems))
                tail_no[i] = tails.setdefault(word[len(stem) :], len(tails))
            else:
                stem_no[i] = -1
                tail_no[i] = tails.setdefault(word, len(tails))
        stem_ids, stem_ends = self._stems(list(stems))
        tail_list = self._whole(list(tails))
        tail_ids = np.concatenate([np.zeros(0, np.uint32), *tail_list])
        tail_sizes = np.array([len(x) for x in tail_list], np.int64)
        tail_starts = np.cumsum(tail_sizes) - tail_sizes
        stem_starts = np.concatenate((np.zeros(1, np.int64), stem_ends))
        stem_sizes = np.append(np.diff(stem_starts), 0)  # the last one stands for "no stem"
        source = np.concatenate((stem_ids, tail_ids))
        begins = np.stack((np.append(stem_starts[: len(stems)], 0)[stem_no], len(stem_ids) + tail_starts[tail_no]), 1).ravel()
        sizes = np.stack((stem_sizes[stem_no], tail_sizes[tail_no]), 1)
        return gather(source, begins, sizes.ravel()), sizes.sum(1)

    def _special_at(self, texts: Texts) -> np.ndarray:
        """Places where a special token may begin."""
        out = np.zeros(len(texts.data), bool)
        for s in self.special:
            if len(texts.data) >= len(s):
                out[: len(texts.data) - 1] |= (texts.data[:-1] == s[0]) & (texts.data[1:] == s[1])
        return out

    def _coded(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Dictionary places of all words, the words' bounds, and which texts are plain."""
        data = texts.data
        odd = _ODD[data] | self._special_at(texts)
        odd[:-1] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
        plain = per_text(odd, texts.bounds) == 0
        w = words(texts, fold=True)
        checks = folded_checks(data, w.starts, w.ends)
        used = np.repeat(plain, w.counts)
        places, wrong = self.table.places(data, w.hashes[used], checks[used], w.starts[used], w.ends[used])
        kept = np.where(plain, w.counts, 0)
        bounds = np.concatenate((np.zeros(1, np.int64), np.cumsum(kept)))
        plain &= per_text(wrong, bounds) == 0
        return places, bounds, plain

    def counts(self, column: pa.Array) -> np.ndarray:
        """Tokens per text: pieces counted once per distinct word, joined to each text's word frequencies, summed."""
        out = []
        for texts in portions(column, ROUND_BYTES):
            places, bounds, plain = self._coded(texts)
            n, n_known = len(texts), max(len(self.table.keys), 1)
            owner = np.repeat(np.arange(n), np.diff(bounds))
            pairs, times = np.unique(owner * n_known + places, return_counts=True)  # a text's word frequencies
            total = np.bincount(pairs // n_known, self.table.sizes[pairs % n_known] * times, n).astype(np.int64)
            for i in np.flatnonzero(~plain):
                total[i] = len(self._whole([text_at(texts, i)])[0])
            out.append(total)
        return np.concatenate([np.zeros(0, np.int64), *out])

    def ids(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text, as uint32."""
        for texts in portions(column, ROUND_BYTES):
            places, bounds, plain = self._coded(texts)
            sizes = self.table.sizes[places]
            flat = gather(self.table.flat, self.table.starts[places], sizes)
            cuts = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))[bounds]
            for i in range(len(texts)):
                yield flat[cuts[i] : cuts[i + 1]] if plain[i] else self._whole([text_at(texts, i)])[0]


def _slices(items: list, size: int) -> Iterator[list]:
    return (items[i : i + size] for i in range(0, len(items), size))


def _encoded(tokenizer, texts: list[str]) -> list[np.ndarray]:
    """Ids of some texts. The library's result holds some hundred bytes a token, so callers take few texts at a time."""
    return [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def gather(source: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pieces ``source[starts[i]:starts[i] + sizes[i]]`` in a row."""
    ends = np.cumsum(sizes, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    own = np.int32 if max(total, len(source)) < 1 << 31 else np.int64
    at = np.repeat((starts - ends + sizes).astype(own), sizes)
    at += np.arange(total, dtype=own)
    return source[at]


def folded_checks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Length and byte sum of each word with A-Z lower-cased."""
    # Sums wrap at 32 bits; what is left of their difference by 65,536 does not.
    run = np.zeros(len(data) + 1, np.uint32)
    np.cumsum(_LOWER[data], dtype=np.uint32, out=run[1:])
    return (ends - starts) * 65536 + ((run[ends] - run[starts]) % np.uint32(65536)).astype(np.int64)


def text_at(texts: Texts, i: int) -> str:
    return texts.data[texts.bounds[i] : texts.bounds[i + 1]].tobytes().decode()


_kept: dict[str, WordPieces] = {}


def word_pieces(path: str) -> WordPieces:
    """One dictionary per Python worker, bounded in size; only a cache, so a lost worker loses nothing."""
    if path not in _kept:
        pa.default_memory_pool().release_unused()  # what batches of earlier tasks left
        _kept[path] = WordPieces(path)
    return _kept[path]
