import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tillcast.llm import token_files as t
from tillcast.llm import range_coder as rc
from tillcast.llm.pretokens import PieceEncoder

ALPHABET = "aZ09 \t\n\x0b\x1c\x85 '''srevelldmtSİé<|endoftext|>,.!🙂漢字　½٣\u0000"


def test_pieces_equal_library(given):
    e, lib = PieceEncoder(t.BYTE_BPE), Tokenizer.from_file(t.BYTE_BPE)
    r = random.Random(1)
    texts = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 30))) for _ in range(4000)]
    for part in (texts, [x for _, x in given], ["", "  ", "a  ", "it's they'll we've 's 'S''s", "<|endoftext|>x"], [""]):
        ids, n = e.encode(part)
        want = [lib.encode(x, add_special_tokens=False).ids for x in part]
        assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1024, 1025, 5000])
def test_coder_round_trip(n):
    g = np.random.default_rng(n)
    for ids in (g.integers(0, 65535, n), g.integers(0, 5, n), np.full(n, 65534), np.zeros(n, dtype=int), np.arange(n)):
        payloads = rc.encode_blocks(ids)
        assert (rc.decode_blocks(payloads, n) == ids).all()
        for k, p in enumerate(payloads):  # each by itself
            part = ids[k * rc.BLOCK:(k + 1) * rc.BLOCK]
            assert (rc.decode_blocks([p], len(part)) == part).all()


def test_coder_compresses(given):
    ids, _ = PieceEncoder(t.BYTE_BPE).encode([x for _, x in given])
    assert sum(map(len, rc.encode_blocks(ids))) < 0.75 * 2 * len(ids)


def test_coder_refuses_ids_out_of_range():
    with pytest.raises(ValueError):
        rc.encode_blocks(np.array([65535]))


def test_segment_checksums_and_single_blocks():
    ids = np.random.default_rng(2).integers(0, 300, 3000)
    data = t.pack_segment(np.array([4, 9]), np.array([True, False]), np.array([1000, 2000]), ids)
    keys, named, sizes, back = t.unpack_segment(data)
    assert keys.tolist() == [4, 9] and named.tolist() == [True, False] and sizes.tolist() == [1000, 2000]
    assert (back == ids).all()
    assert (t.read_block(data, 1) == ids[1024:2048]).all() and (t.read_block(data, 2) == ids[2048:]).all()
    damaged = bytearray(data)
    damaged[-20] ^= 1
    with pytest.raises(ValueError):
        t.unpack_segment(bytes(damaged))
    with pytest.raises(ValueError):
        t.read_block(bytes(damaged), 2)


def check(got, docs, exact_order=True):
    lib = Tokenizer.from_file(t.BYTE_BPE)
    at, want = 0, []
    for i, x in sorted(docs, key=lambda r: (r[0] is not None, r[0])):
        ids = lib.encode(x or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    have = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) if exact_order else None
    if exact_order:
        assert have == sorted(want)
    else:
        key = lambda r: tuple((v is not None, v) for v in r)
        assert sorted([(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got], key=key) == sorted([(w[0], w[2], w[3]) for w in want], key=key)
        spans = sorted((r["start"], r["n_tokens"]) for r in got)
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))


def test_query(spark, sf_dir, given):
    check(t.op8_token_files(spark, sf_dir).collect(), given)


def test_small_segments(make_docs, given, monkeypatch):
    docs = given[:40]
    check(t.read_tokens(t.write_tokens(make_docs(docs))).collect(), docs)


def test_odd_rows_and_order(odd_docs, odd_rows):
    rows = t.read_tokens(t.write_tokens(odd_docs)).collect()
    check(rows, odd_rows, exact_order=False)
    starts = sorted((r["start"], r["doc_id"]) for r in rows)
    ids = [-1 if i is None else i for _, i in starts]
    assert ids == sorted(ids)


def test_empty_table(empty_docs):
    assert t.read_tokens(t.write_tokens(empty_docs)).count() == 0


def thue_morse(n, letters="ab"):
    out = [0]
    while len(out) < n:
        out += [1 - x for x in out]
    return "".join(letters[x] for x in out)


@pytest.mark.parametrize("n", [1024, 2048])
def test_pieces_with_equal_hashes_are_told_apart(n):
    """Two words whose polynomial hashes agree modulo a power of two, whatever the base."""
    e, lib = PieceEncoder(t.BYTE_BPE), Tokenizer.from_file(t.BYTE_BPE)
    texts = [thue_morse(n), thue_morse(n, "ba"), "short " + thue_morse(n, "ba") + " 漢字漢字漢字 café", thue_morse(n)]
    ids, sizes = e.encode(texts)
    want = [lib.encode(x, add_special_tokens=False).ids for x in texts]
    assert want[0] != want[1] and sizes.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_short_pieces_are_their_own_key():
    """Null characters, lengths around the key's seven characters, characters beyond Latin-1."""
    e, lib = PieceEncoder(t.BYTE_BPE), Tokenizer.from_file(t.BYTE_BPE)
    texts = ["\0", "\0\0", "a\0b", "abcdefg", "abcdefgh", "abcdefghi", "ÿÿÿÿÿÿÿ", "ÿÿÿÿÿÿÿÿ", "Āa aĀ", "š" * 7, "s" * 7, "a" * 100_000]
    ids, sizes = e.encode(texts * 2)
    want = [lib.encode(x, add_special_tokens=False).ids for x in texts * 2]
    assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


class Spy:
    def __init__(self, model):
        self.model, self.asked = model, []

    def tokenize(self, piece):
        self.asked.append(piece)
        return self.model.tokenize(piece)


def same_ids(e, texts):
    lib = Tokenizer.from_file(t.BYTE_BPE)
    ids, sizes = e.encode(texts)
    want = [lib.encode(x, add_special_tokens=False).ids for x in texts]
    assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_model_is_asked_once_for_each_piece(given):
    """Neither a second text nor a second chunk asks again."""
    e = PieceEncoder(t.BYTE_BPE)
    e.model = Spy(e.model)
    texts = [x or "" for _, x in given if "<|" not in (x or "")]
    same_ids(e, texts)
    asked = len(e.model.asked)
    assert asked and asked == len(set(e.model.asked))
    same_ids(e, texts[::-1])
    assert len(e.model.asked) == asked


def test_pieces_at_one_address_are_told_apart(monkeypatch):
    monkeypatch.setattr(PieceEncoder, "_address", lambda self, a, b: np.full(len(a), len(self.place) - 2, dtype=np.int64))
    e = PieceEncoder(t.BYTE_BPE)
    for k in range(3):
        same_ids(e, [f"word{i} w{i + k} a longer{'r' * i} one" for i in range(40)])


def test_pieces_around_the_size_of_a_key_and_small_caches(monkeypatch):
    from tillcast.llm import pretokens
    texts = ["x" * n for n in range(1, 40)] + ["é" * n for n in range(1, 20)] + ["漢" * n + "　z　　y" for n in range(1, 9)]
    e = PieceEncoder(t.BYTE_BPE)
    same_ids(e, texts * 2)
    monkeypatch.setattr(pretokens, "CACHE_PIECES", 5)
    monkeypatch.setattr(pretokens, "CACHE_LONG_BYTES", 20)
    for i in range(0, len(texts), 3):
        same_ids(e, texts[i:i + 5])
    assert e.n < 40


def test_table_of_pieces_grows():
    """More pieces than the first table has addresses, some longer than a key."""
    e = PieceEncoder(t.BYTE_BPE)
    words = [f"q{i:x}" + "z" * (i % 3 * 8) for i in range(20_000)]
    for i in range(0, len(words), 6000):
        same_ids(e, words[i:i + 6000])
    same_ids(e, words)


def test_search_by_words_of_ends():
    g = np.random.default_rng(3)
    ends = np.sort(g.choice(np.arange(1, rc.TOTAL), (5, 255)), axis=1)
    ends = np.concatenate([ends, np.full((5, 1), rc.TOTAL)], axis=1).astype(np.uint16)
    levels = [rc._words(ends[:, k - 1::k]) for k in (64, 16, 4)] + [rc._words(ends)]
    for lane in range(5):
        value = np.arange(rc.TOTAL, dtype=np.uint64)
        got = rc._search(levels, np.full(rc.TOTAL, lane), value)
        assert (got - 256 * lane == np.searchsorted(ends[lane], value, side="right")).all()


def test_reading_without_ids(make_docs, given):
    segments = t.write_tokens(make_docs(given[:20]))
    short = t.read_tokens(segments, with_ids=False)
    assert "ids" not in short.columns
    assert sorted(short.collect()) == sorted(t.read_tokens(segments).drop("ids").collect())


@pytest.mark.parametrize("n", [1, 90, 210, 310, 1000])
def test_segments_of_a_range_are_alike_in_size(n, monkeypatch):
    """No short segment beside a full one; documents keep their order over two ranges."""
    import pyarrow as pa
    monkeypatch.setattr(t, "SEGMENT_IDS", 1000)
    monkeypatch.setattr(t, "CHUNK_BYTES", 200)
    texts = [f"some words {i} here" for i in range(n)]
    rows = pa.RecordBatch.from_pydict({"id": [*range(n), None], "text": [*texts, ""], "part": pa.array([3] * n + [5], pa.int32())})
    got = pa.Table.from_batches(t._segments(t.BYTE_BPE, 2)(iter([rows]))).to_pylist()
    assert [r["part"] for r in got] == [3] * (len(got) - 1) + [5] and [r["seq"] for r in got] == [*range(len(got) - 1), 0]
    sizes = [r["n_ids"] for r in got[:-1]]
    assert max(sizes) <= 1510 and (len(sizes) == 1 or min(sizes) >= 740)
    back = [t.unpack_segment(r["data"]) for r in got]
    assert np.concatenate([b[0] for b in back[:-1]]).tolist() == list(range(n)) and not back[-1][1].any()
    lib = Tokenizer.from_file(t.BYTE_BPE)
    want = [i for x in texts for i in [*lib.encode(x, add_special_tokens=False).ids, 2]]
    assert np.concatenate([b[3] for b in back[:-1]]).tolist() == want and back[-1][3].tolist() == [2]
