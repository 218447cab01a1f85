"""Counts, token files, BPE and packing against the tokenizers library."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tallywake.llm import bpe, packing, pieces, token_counts, token_file
from tallywake.llm.differencing import near_equal, windows_within
from tallywake.llm.storage import new_folder, table

from .conftest import AWKWARD

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def word_library():
    return pieces.load(pieces.tokenizer_file("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def byte_library():
    return pieces.load(pieces.tokenizer_file("byte_bpe_50k.json"))


def ids_of(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4")


def random_texts(n, seed):
    rng = np.random.default_rng(seed)
    parts = ["a", "b", "A", "é", "É", "ß", "\n", " ", " ", " ", "\t", "|", "'", "s", "'s", "'ll", "\x1c", "漢", "ab c ", "the end ", "1", "²", "ª", "\x7f", "\x00", "ÿ", "<|endoftext|>", "́", "\xa0", "×", "÷", "\r", "\x0b"]
    return ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(n)]


def test_word_ids_and_counts_are_the_library_s(word_library):
    texts = [t for _, t in AWKWARD] + random_texts(1500, 1)
    want = [ids_of(word_library, t).tolist() for t in texts]
    encoder = pieces.WordPieces(pieces.tokenizer_file("word_bpe_49k.json"), most_words=300)  # forgets on the way
    assert [x.tolist() for x in encoder.ids(pa.array(texts))] == want
    assert encoder.counts(pa.array(texts)).tolist() == [len(w) for w in want]
    assert encoder.counts(pa.array([], pa.string())).tolist() == []


def test_byte_ids_and_text_are_the_library_s(byte_library):
    texts = [t for _, t in AWKWARD] + random_texts(1500, 2) + ["a" * 900, "".join(np.random.default_rng(3).choice(list("abcdefgh01"), 3000))]
    want = [ids_of(byte_library, t).tolist() for t in texts]
    coder = bpe.ByteBpe(pieces.tokenizer_file("byte_bpe_50k.json"), most_words=300)
    assert [x.tolist() for x in coder.encode_all(pa.array(texts))] == want
    rng = np.random.default_rng(4)
    for ids in want[:200] + [rng.integers(0, 50257, 20).tolist() for _ in range(200)]:
        assert coder.decode(np.array(ids, np.int64)) == byte_library.decode(ids, skip_special_tokens=False)


def test_counts_of_awkward_rows(spark, documents, word_library):
    got = token_counts.token_counts(documents(AWKWARD), limit=100).collect()
    want = [(i, len((t or "").encode()), len(n := ids_of(word_library, t)), len(n) > 100) for i, t in AWKWARD]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert token_counts.token_counts(documents([])).count() == 0


def test_bpe_of_awkward_rows(documents, byte_library):
    got = sorted(map(tuple, bpe.digests(documents(AWKWARD)).collect()), key=repr)
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    want = [(i, len(ids_of(byte_library, t)), sha(ids_of(byte_library, t).tobytes()), sha((t or "").encode())) for i, t in AWKWARD]
    assert got == sorted(want, key=repr)
    real = bpe.encode_and_decode(documents(AWKWARD[:6])).collect()
    assert [r.decoded for r in real] == [t or "" for _, t in AWKWARD[:6]]
    assert bpe.digests(documents([])).count() == 0


@pytest.mark.parametrize("top", [2**8, 2**16, 2**32])
def test_codes_give_any_token_directly(top):
    ids = np.random.default_rng(top).integers(0, top, 5000, dtype=np.uint64).astype(np.uint32)
    ids[::3] %= 200
    codes = token_file.Codes.of(ids)
    places = np.random.default_rng(1).integers(0, len(ids), 700)
    assert (codes.take(places) == ids[places]).all()
    for a, b in [(0, 0), (0, 5000), (513, 514), (7, 4999), (4999, 5000)]:
        assert (codes.span(a, b) == ids[a:b]).all()
    assert len(token_file.Codes.of(ids[:0]).span(0, 0)) == 0


def test_a_segment_is_decoded_once(monkeypatch):
    """Documents of a segment are cut from its ids, not looked up one by one."""
    sizes = [1, 700, 3, 0, 2000, 1]
    ids = np.random.default_rng(5).integers(0, 49_000, sum(sizes)).astype(np.uint32)
    codes, ranked, rank = token_file.Codes.of(ids), [], token_file.Level.rank
    monkeypatch.setattr(token_file.Level, "rank", lambda self, i: ranked.append(1) or rank(self, i))
    runs = codes.split(sizes)
    assert [len(r) for r in runs] == [4 * n for n in sizes] and b"".join(runs) == ids.astype("<u4").tobytes()
    assert len(ranked) < len(codes.levels) and token_file.Codes.of(ids[:0]).split([]) == []


def test_new_words_go_through_the_library_in_slices():
    """Its results hold some hundred bytes a token, so not all new words of a round are asked for at once."""
    pieces_of = pieces.WordPieces(pieces.tokenizer_file("word_bpe_49k.json"))
    asked = []

    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def encode_batch_fast(self, texts, **kwargs):
            asked.append(sum(len(t.split()) for t in texts))
            return self.tokenizer.encode_batch_fast(texts, **kwargs)

    letters = ["".join(chr(97 + n // 26**k % 26) for k in range(4)) for n in range(5000)]
    text = " ".join([*letters, *(f"x{n}y" for n in range(3000))])
    want = pieces_of.tokenizer.encode(text, add_special_tokens=False).ids
    pieces_of.bare, pieces_of.tokenizer = Counted(pieces_of.bare), Counted(pieces_of.tokenizer)
    assert next(pieces_of.ids(pa.array([text]))).tolist() == want
    assert max(asked) <= 1000 and sum(asked) >= 8000


def test_token_file(spark, documents, word_library, monkeypatch):
    monkeypatch.setattr(token_file, "SEGMENT_IDS", 64)
    docs = documents(AWKWARD)
    path = new_folder(spark, "test-tokens")
    token_file.write_tokens(docs, path)
    rows = token_file.read_tokens(spark, path).orderBy("start").collect()
    order = sorted(AWKWARD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = [np.append(ids_of(word_library, t), np.uint32(2)).astype("<u4") for _, t in order]
    assert [r.doc_id for r in rows] == [i for i, _ in order]
    assert [r.n_tokens for r in rows] == [len(w) for w in want]
    assert [r.start for r in rows] == np.cumsum([0] + [len(w) for w in want])[:-1].tolist()
    assert [r.ids for r in rows] == [w.tobytes() for w in want]
    assert [r.ids_crc32 for r in rows] == [zlib.crc32(w.tobytes()) for w in want]
    whole = np.concatenate(want)
    places = [0, 1, 17, len(whole) - 1, len(whole) + 5, 17]
    got = token_file.token_at(spark, path, spark.createDataFrame([(p,) for p in places], "place long")).collect()
    assert sorted(map(tuple, got)) == sorted((p, int(whole[p])) for p in places if p < len(whole))
    assert token_file.round_trip(documents([])).count() == 0


def test_differencing_is_near_equal_and_within_capacity():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 500, 700)
    window, sums = near_equal(sizes, 40)
    assert (np.bincount(window, sizes, 40) == sums).all()
    assert sums.max() - sums.min() <= 5
    window, sums = windows_within(sizes, 2048)
    assert sums.max() <= 2048 and (np.bincount(window, sizes, len(sums)) == sums).all()
    assert len(sums) <= 1.03 * sizes.sum() / 2048 + 1
    assert windows_within(np.array([2048, 2048]), 2048)[1].tolist() == [2048, 2048]
    assert windows_within(np.array([1500, 1500, 1500]), 2048)[1].tolist() == [1500] * 3  # the count rises until all fit
    assert len(windows_within(np.zeros(0, np.int64), 2048)[0]) == 0


def checked_packing(rows, docs, library):
    full = defaultdict(list)
    for i, t in docs:
        full[i].append(np.append(ids_of(library, t), np.uint32(1)).astype("<u4"))
    pieces_of, used = defaultdict(int), defaultdict(list)
    for r in rows:
        own = [x[r.start : r.start + r.length].tobytes() for x in full[r.doc_id] if len(x) == r.doc_tokens]
        assert r.ids_crc32 in map(zlib.crc32, own)
        pieces_of[r.doc_id] += r.length
        used[r.sequence_id].append((r.offset, r.length))
    assert pieces_of == {i: sum(map(len, x)) for i, x in full.items()}
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    return len(used), sum(pieces_of.values())


def test_packing_of_awkward_rows(documents, word_library):
    checked_packing(packing.pack(documents(AWKWARD)).collect(), AWKWARD, word_library)
    assert packing.pack(documents([])).count() == 0


def test_packing_fills_windows(spark, word_library):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    packed = packing.pack(docs, keep_ids=True).cache()
    windows, total = checked_packing(packed.collect(), [tuple(r) for r in docs.collect()], word_library)
    assert total / (windows * 2048) > 0.98
    ids = {r.sequence_id: r for r in packing.sequences(packed, pad_id=7).collect()}
    assert all(len(r.ids) == 2048 * 4 for r in ids.values())
    for r in packed.collect():
        assert ids[r.sequence_id].ids[r.offset * 4 : (r.offset + r.length) * 4] == r.ids
    assert all(np.frombuffer(r.ids, "<u4")[r.n_tokens :].tolist() == [7] * (2048 - r.n_tokens) for r in ids.values())
