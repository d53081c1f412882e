import hashlib
import random

from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tillcast.llm import bpe, token_counts

ALPHABET = "aZ09 \t\n\x0b\x1c\x85 'sSΣσςİéÉé<|endoftext|>,.!🙂漢字​　ǅ½²\u0000٣"


def library():
    t = Tokenizer.from_file(bpe.WORD_BPE)
    t.no_truncation()
    t.no_padding()
    return t


def test_encoding_equals_library(given):
    t, v = library(), bpe.Vocabulary(bpe.WORD_BPE)
    r = random.Random(5)
    texts = [x for _, x in given] + ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 40))) for _ in range(2000)]
    for x in [*texts, "<|endoftext|>a<|startoftext|>", "<|endoftext", "a" * 5000, "it's they'll LL İI", "ΑΣ ΑΣ."]:
        want = t.encode(x, add_special_tokens=False).ids
        assert v.encode(x) == want
        assert v.decode(want) == t.decode(want, skip_special_tokens=False)


def test_cache_limit_changes_nothing(given, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 5)
    small, large = bpe.Vocabulary(bpe.WORD_BPE), bpe.Vocabulary(bpe.WORD_BPE)
    large.cache.clear()
    for _, x in given[:20]:
        assert small.encode(x) == [i for p in large.pieces(large.normal(x)) for i in large.piece(p)]


def test_odd_rows(odd_docs):
    t = library()
    got = bpe.decode(bpe.encode(odd_docs)).select("doc_id", "ids", "decoded").collect()
    texts = [r["text"] or "" for r in odd_docs.select("text").collect()]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert sorted(map(tuple, want)) == sorted(tuple(r["ids"]) for r in got)
    assert sorted(t.decode(x, skip_special_tokens=False) for x in want) == sorted(r["decoded"] for r in got)


def test_query(spark, sf_dir, given):
    t = library()
    got = {r["doc_id"]: r for r in bpe.op4_bpe(spark, sf_dir).collect()}
    assert len(got) == len(given)
    for i, x in given:
        ids = t.encode(x, add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_decode_null_and_empty_lists(spark):
    df = spark.createDataFrame([(1, [5, 6]), (2, []), (3, None)], "k int, ids array<int>")
    got = {r["k"]: r["decoded"] for r in bpe.decode(df).collect()}
    v = bpe.Vocabulary(bpe.WORD_BPE)
    assert got == {1: v.decode([5, 6]), 2: "", 3: ""}


def greedy(pieces, longest, word):
    n = i = 0
    while i < len(word):
        k = min(longest, len(word) - i)
        while k > 1 and word[i:i + k] not in pieces:
            k -= 1
        i += k
        n += 1
    return n


def test_counts_equal_greedy_pieces(spark, sf_dir, given, odd_docs):
    pieces = set(token_counts.read_pieces(token_counts.PIECES))
    longest = max(map(len, pieces))
    memo = {}

    def count(text):
        words = (text or "").encode().split()
        for w in words:
            if w not in memo:
                memo[w] = greedy(pieces, longest, b" " + w) if len(w) < 10_000 else None
        return len(words), None if None in (memo[w] for w in words) else sum(memo[w] for w in words)

    got = {r["doc_id"]: (r["n_words"], r["n_pieces"]) for r in token_counts.op2_token_counts(spark, sf_dir).collect()}
    assert got == {i: count(x) for i, x in given}
    for r in token_counts.token_counts(odd_docs).join(odd_docs.select(F.col("doc_id").alias("d"), "text").distinct(), F.col("doc_id") == F.col("d")).collect():
        words, n = count(r["text"])
        assert r["n_words"] == words and (n is None or r["n_pieces"] == n)


def test_counts_small_vocabulary():
    r = random.Random(3)
    pieces = {b"ab", b"abcab", b"bca", b"cabc", b"aaaa", b"aab", b"bb"}
    m = token_counts.LongestMatch(pieces)
    for _ in range(3000):
        w = bytes(r.choice(b"abc") for _ in range(r.randint(0, 14)))
        assert m.count(w) == greedy(pieces, 5, w)


def test_empty_table(empty_docs):
    assert bpe.decode(bpe.encode(empty_docs)).count() == 0
    assert token_counts.token_counts(empty_docs).count() == 0
