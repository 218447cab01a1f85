"""Byte-level BPE encoding and decoding in batches of numpy merge rounds."""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallywake.llm.pieces import DICTIONARY_WORDS, ROUND_BYTES, IdTable, folded_checks, gather, text_at, tokenizer_file
from tallywake.llm.storage import reach_workers
from tallywake.llm.words import Texts, mix, per_text, portions, words

#: Fixed value: the pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens of more symbols are merged one pair at a time off a heap, not in rounds.
LONG_SYMBOLS = 256
_NONE = np.iinfo(np.int64).max


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte in vocabulary files."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return [out[b] for b in range(256)]


class ByteBpe:
    """Encoder and decoder for a byte-level BPE vocabulary file.

    Symbols of many pre-tokens lie in one flat array. In each round the rank of
    every neighbouring pair is found by binary search over the sorted pair keys,
    each pre-token's lowest-rank pairs are merged, and finished pre-tokens leave.
    """

    def __init__(self, path: str, most_words: int = DICTIONARY_WORDS) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self._pattern = regex.compile(PATTERN)
        characters = _byte_characters()
        self.byte_ids = np.array([vocab[c] for c in characters], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.pair_keys = keys[order]
        self.pair_ranks = order
        self.pair_ids = np.array([vocab[a + b] for a, b in merges], np.int64)[order]
        byte_of = {c: b for b, c in enumerate(characters)}
        spelled = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            spelled[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            spelled[i] = token.encode()
        self.token_bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.token_sizes = np.array([len(s) for s in spelled], np.int64)
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes
        self.table = IdTable(self._ids_of_pieces, most_words)
        self.gaps: dict[tuple[bytes, bool], np.ndarray] = {}

    # Encoding

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of each pair; pairs that never merge get the largest rank."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], _NONE), self.pair_ids[at]

    def merge(self, pretokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens in a row, and the number of ids of each."""
        sizes = np.array([len(p) for p in pretokens], np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(pretokens), np.uint8)]
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        number = np.arange(len(pretokens))
        long = sizes > LONG_SYMBOLS
        if long.any():
            starts = np.cumsum(sizes) - sizes
            for i in np.flatnonzero(long):
                ids = self._merge_long(symbols[starts[i] : starts[i] + sizes[i]])
                done.append((np.array([i]), np.array([len(ids)]), ids))
            symbols, sizes, number = symbols[np.repeat(~long, sizes)], sizes[~long], number[~long]
        while len(number):
            starts = np.cumsum(sizes) - sizes
            ranks, merged = np.full(len(symbols), _NONE), np.zeros(len(symbols), np.int64)
            if len(symbols) > 1:
                ranks[:-1], merged[:-1] = self._ranked(symbols[:-1], symbols[1:])
            ranks[(starts + sizes - 1)[sizes > 0]] = _NONE
            filled = sizes > 0
            lowest = np.full(len(sizes), _NONE)
            lowest[filled] = np.minimum.reduceat(ranks, starts[filled]) if filled.any() else _NONE
            finished = lowest == _NONE
            if finished.any():
                out = np.repeat(finished, sizes)
                done.append((number[finished], sizes[finished], symbols[out]))
                keep = ~out
                symbols, ranks, merged = symbols[keep], ranks[keep], merged[keep]
                sizes, number, lowest = sizes[~finished], number[~finished], lowest[~finished]
                if not len(number):
                    break
            chosen = np.flatnonzero(ranks == np.repeat(lowest, sizes))
            # In a run of the same symbol the pairs overlap: every second one counts, from the left.
            first = np.ones(len(chosen), bool)
            first[1:] = np.diff(chosen) != 1
            since = np.arange(len(chosen)) - np.maximum.accumulate(np.where(first, np.arange(len(chosen)), 0))
            chosen = chosen[since % 2 == 0]
            symbols[chosen] = merged[chosen]
            gone = np.zeros(len(symbols), bool)
            gone[chosen + 1] = True
            owner = np.repeat(np.arange(len(sizes)), sizes)
            sizes = sizes - np.bincount(owner[chosen], minlength=len(sizes))
            symbols = symbols[~gone]
        counts = np.zeros(len(pretokens), np.int64)
        starts_in = np.zeros(len(pretokens), np.int64)
        at = 0
        for numbers, each, ids in done:
            counts[numbers] = each
            starts_in[numbers] = at + np.cumsum(each) - each
            at += len(ids)
        flat = np.concatenate([np.zeros(0, np.int64), *[ids for _, _, ids in done]])
        return gather(flat, starts_in, counts).astype(np.uint32), counts

    def _merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """The same merges for one very long pre-token: pairs off a heap by rank, then place."""
        n = len(symbols)
        ids = symbols.tolist()
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        ranks, merged = self._ranked(symbols[:-1], symbols[1:])
        heap = [(r, i, ids[i], ids[i + 1], m) for i, (r, m) in enumerate(zip(ranks.tolist(), merged.tolist())) if r != _NONE]
        heapq.heapify(heap)
        known: dict[tuple[int, int], tuple[int, int]] = {}

        def push(i: int) -> None:
            j = after[i]
            if i < 0 or j < 0:
                return
            pair = (ids[i], ids[j])
            if pair not in known:
                r, m = self._ranked(np.array([pair[0]]), np.array([pair[1]]))
                known[pair] = (int(r[0]), int(m[0]))
            r, m = known[pair]
            if r != _NONE:
                heapq.heappush(heap, (r, i, *pair, m))

        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = m, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return np.array([x for x in ids if x >= 0], np.int64)

    def _ids_of_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of strings that pre-tokens never leave: each is cut into pre-tokens, which are merged together."""
        cut = [[p.encode() for p in self._pattern.findall(piece.decode())] for piece in pieces]
        distinct = {p: i for i, p in enumerate(dict.fromkeys(p for c in cut for p in c))}
        flat, sizes = self.merge(list(distinct))
        numbers = np.array([distinct[p] for c in cut for p in c], np.int64)
        per_piece = np.concatenate((np.zeros(1, np.int64), np.cumsum([len(c) for c in cut]))).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        return gather(flat, starts[numbers], sizes[numbers]), per_text(sizes[numbers], per_piece)

    def encode(self, text: str) -> np.ndarray:
        """Ids of one text, special tokens in it included, without any dictionary."""
        out, at = [np.zeros(0, np.uint32)], 0
        for m in self._special.finditer(text) if self._special else ():
            out += [self._ids_of_pieces([text[at : m.start()].encode()])[0], np.array([self.special[m[0]]], np.uint32)]
            at = m.end()
        return np.concatenate([*out, self._ids_of_pieces([text[at:].encode()])[0]])

    def _gap(self, raw: bytes, trailing: bool) -> np.ndarray:
        """Ids of the white space before a word, less the space that the word itself takes."""
        if (raw, trailing) not in self.gaps:
            if len(self.gaps) > 100_000:
                self.gaps.clear()
            parts = [raw] if trailing else [raw[:-1], raw[-1:] if raw[-1:] != b" " else b""]
            self.gaps[raw, trailing] = self.merge([p for p in parts if p])[0]
        return self.gaps[raw, trailing]

    def encode_all(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text. Words with the space before them are looked up; odd texts go one by one."""
        for texts in portions(column, ROUND_BYTES):
            data, n = texts.data, len(texts)
            plain = per_text(self._odd(texts), texts.bounds) == 0
            w = words(texts)
            where = np.arange(len(w.starts)) + w.text_of  # each text has one entry more, for what follows its last word
            total = len(w.starts) + n
            tail = w.bounds[1:] + np.arange(n)
            gap_from, gap_to = np.zeros(total, np.int64), np.zeros(total, np.int64)
            gap_to[where], gap_to[tail] = w.starts, texts.bounds[1:]
            gap_from[where + 1] = w.ends
            gap_from[w.bounds[:-1] + np.arange(n)] = texts.bounds[:-1]
            gap = gap_to - gap_from
            last = data[np.maximum(gap_to - 1, 0)] if len(data) else np.zeros(total, np.uint8)
            is_tail = np.zeros(total, bool)
            is_tail[tail] = True
            spaced = (gap > 0) & (last == 0x20) & ~is_tail
            used = np.repeat(plain, w.counts)
            flag = spaced[where]
            keys = mix(w.hashes + flag.astype(np.uint64))
            checks = folded_checks(data, w.starts, w.ends)
            places, wrong = self.table.places(data, keys[used], checks[used], (w.starts - flag)[used], w.ends[used])
            # Segments: the gap of each entry, then its word.
            shown = np.flatnonzero((gap > 0) & ~(spaced & (gap == 1)) & np.repeat(plain, w.counts + 1))
            newline = self._gap(b"\n", False)
            simple = (gap[shown] == 1) & (last[shown] == 0x0A)
            others = {int(e): self._gap(data[gap_from[e] : gap_to[e]].tobytes(), bool(is_tail[e])) for e in shown[~simple]}
            extra = np.concatenate([newline, *others.values()]).astype(np.uint32)
            starts, sizes = np.zeros((total, 2), np.int64), np.zeros((total, 2), np.int64)
            base = self.table.used
            starts[shown[simple], 0], sizes[shown[simple], 0] = base, len(newline)
            if others:
                each = np.array([len(x) for x in others.values()], np.int64)
                at = np.array(list(others), np.int64)
                starts[at, 0], sizes[at, 0] = base + len(newline) + np.cumsum(each) - each, each
            starts[where[used], 1], sizes[where[used], 1] = self.table.starts[places], self.table.sizes[places]
            flat = gather(np.concatenate((self.table.flat[:base], extra)), starts.ravel(), sizes.ravel())
            cuts = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes.sum(1))))[w.bounds + np.arange(n + 1)]
            failed = np.zeros(len(w.starts), bool)
            failed[used] = wrong
            plain &= per_text(failed, w.bounds) == 0
            for i in range(n):
                yield flat[cuts[i] : cuts[i + 1]] if plain[i] else self.encode(text_at(texts, i))

    def _odd(self, texts: Texts) -> np.ndarray:
        """Places with white space beyond ASCII's six kinds, or where a special token may begin."""
        data = texts.data
        odd = ((data >= 0x1C) & (data <= 0x1F)) | (data == 0x85)
        follows = data[1:]
        odd[:-1] |= (data[:-1] == 0xC2) & ((follows == 0x85) | (follows == 0xA0))
        odd |= (data == 0xE1) | (data == 0xE3)
        odd[:-1] |= (data[:-1] == 0xE2) & ((follows == 0x80) | (follows == 0x81))
        for s in map(str.encode, self.special):
            odd[:-1] |= (data[:-1] == s[0]) & (follows == s[1]) if len(s) > 1 else data[:-1] == s[0]
        return odd

    # Decoding

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return gather(self.token_bytes, self.token_starts[ids], self.token_sizes[ids]).tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``; bytes that are no UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


_kept: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    """One encoder per Python worker, its dictionary bounded; only a cache."""
    if path not in _kept:
        _kept[path] = ByteBpe(path)
    return _kept[path]


def encode_and_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Ids of every whole text and the text that they decode to.

    Returns doc_id, ids (binary, little-endian unsigned 32-bit) and decoded, one
    row per input row, repeated rows included. A null or empty text has no ids
    and decodes to the empty text; a null doc_id stays null. Other columns are
    not looked at.
    """
    return _mapped(docs, path, [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())], lambda ids, text: (ids.tobytes(), text))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of ``encode_and_decode``, made in the task that has the ids."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _mapped(docs, path, fields, lambda ids, text: (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))


def _mapped(docs: DataFrame, path: str | None, fields: list[T.StructField], result) -> DataFrame:
    path = path or tokenizer_file("byte_bpe_50k.json")
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in batches:
            rows = [result(ids.astype("<u4"), bpe.decode(ids)) for ids in bpe.encode_all(batch.column(1))]
            columns = list(zip(*rows)) or [()] * len(fields)
            kinds = {T.BinaryType(): pa.binary(), T.StringType(): pa.string(), T.LongType(): pa.int64()}
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, kinds[f.dataType]) for c, f in zip(columns, fields)]], names=schema.names)

    reach_workers(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, schema)
