import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute

from tillcast.llm import suffix_dedup as s
from tillcast.llm.suffix_sort import segmented_sort


def brute(pairs):
    """Per (id, text): bytes, removed, runs, kept."""
    big = 1 << 63
    first = {}
    for i, t in pairs:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            k = b[p:p + 50]
            first[k] = min(first.get(k, big), big if i is None else i)
    out = []
    for i, t in pairs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p:p + 50]] < (big if i is None else i):
                gone[p:p + 50] = b"\1" * 50
        runs = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def key(r):
    return tuple((x is not None, x) for x in r)


def run(docs):
    return sorted(((r["row"]["doc_id"], len(r["bytes"] or b""), len(r["bytes"] or b"") - len(r["kept"] or b""), len(r["starts"]),
                    bytes(r["kept"] or b"")) for r in s.dedup_substrings(docs).collect()), key=key)


def test_random_texts_equal_brute_force(make_docs):
    r = random.Random(4)
    words = ["".join(r.choice("abé") for _ in range(r.randint(1, 4))) for _ in range(12)]
    passages = [" ".join(r.choice(words) for _ in range(40)) for _ in range(6)]
    pairs = []
    for i in range(60):
        parts = []
        for _ in range(r.randint(0, 5)):
            p = r.choice(passages)
            a = r.randint(0, len(p) // 2)
            parts.append(p[a:r.randint(a, len(p))] if r.random() < 0.7 else " ".join(r.choice(words) for _ in range(20)))
        pairs.append((r.randint(0, 40), " ".join(parts)))
    pairs += [(None, passages[0]), (None, passages[0]), (3, "ab" * 400), (50, "ab" * 300), (51, "z" * 49), (52, "z" * 49), (53, "z" * 50), (54, "z" * 50)]
    assert run(make_docs(pairs)) == sorted(brute(pairs), key=key)


def test_odd_rows(odd_docs, odd_rows):
    small = [(i, t) for i, t in odd_rows if t is None or len(t) < 1000]
    got = [x for x in run(odd_docs) if x[1] < 2000]
    assert got == sorted([x for x in brute(small) if x[1] < 2000], key=key)


def test_query_equals_brute_force(spark, sf_dir, given):
    got = {r["doc_id"]: r for r in s.op5_suffix_dedup(spark, sf_dir).collect()}
    assert len(got) == len(given)
    for i, size, gone, runs, kept in brute(given):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (size, gone, runs)
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_whole_characters_and_columns(make_docs):
    shared = "é" * 40  # 80 bytes
    docs = make_docs([(1, "a" + shared + "b"), (2, "x" * 60 + shared[:39] + "ê tail"), (3, None)])
    out = s.remove_repeats(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    # The match ends inside the last character: what is left of it goes as well.
    assert got == {1: "a" + shared + "b", 2: "x" * 60 + " tail", 3: None}


def test_empty_table(empty_docs):
    assert s.dedup_substrings(empty_docs).count() == 0
    assert s.remove_repeats(empty_docs).count() == 0


def test_segmented_sort():
    r = np.random.default_rng(2)
    for _ in range(60):
        n = int(r.integers(0, 60))
        rows = r.integers(0, 2, (n, 9)).astype(np.uint8)
        segment = np.sort(r.integers(0, 5, n))
        order, lcp = segmented_sort(rows, segment)
        got = [(int(segment[i]), rows[i].tobytes()) for i in order]
        assert got == sorted((int(segment[i]), rows[i].tobytes()) for i in range(n))
        for k in range(n):
            if k == 0 or segment[order[k]] != segment[order[k - 1]]:
                assert lcp[k] == -1
            else:
                same = rows[order[k]] == rows[order[k - 1]]
                assert lcp[k] == (9 if same.all() else int(np.argmin(same)))


def test_hash_collisions_are_found(monkeypatch):
    from tillcast.llm import suffix_sort
    rows = np.random.default_rng(3).integers(0, 3, (50, 8)).astype(np.uint8)
    monkeypatch.setattr(suffix_sort, "prefix_hashes", lambda x: np.zeros((x.shape[1] + 1, len(x)), dtype=np.uint64))
    order, lcp = suffix_sort.segmented_sort(rows, np.zeros(50, dtype=np.int64))
    assert [rows[i].tobytes() for i in order] == sorted(x.tobytes() for x in rows)


def _surrounded(n, phrase):
    r = random.Random(8)
    side = lambda: "".join(r.choice("abcdefghij ") for _ in range(60))
    return [(i, side() + phrase + side()) for i in range(n)]


def test_hot_anchors_equal_brute_force(make_docs):
    r = random.Random(6)
    pairs = _surrounded(40, "a phrase of all, less than a window")
    passage = "".join(r.choice("klmnopqé") for _ in range(150))
    pairs += [(100 + i, x[:50] + passage[r.randint(0, 20):150 - r.randint(0, 20)] + x[-50:]) for i, (_, x) in enumerate(pairs[:30])]
    pairs += [(None, pairs[50][1]), (None, pairs[51][1] + "!"), (105, pairs[60][1] + "?"), (7, passage), (200, "xy" * 300), (201, "xy" * 200)]
    docs, want = make_docs(pairs), sorted(brute(pairs), key=key)
    for hot in (0, 5, 1 << 30):
        assert sorted(((x["row"]["doc_id"], len(x["bytes"]), len(x["bytes"]) - len(x["kept"]), len(x["starts"]), bytes(x["kept"]))
                       for x in s.dedup_substrings(docs, hot=hot).collect()), key=key) == want


def test_a_hot_anchor_makes_no_large_group():
    n, pairs = 16, [(i, x.encode()) for i, x in _surrounded(400, "a phrase of all, less than a window")]
    keys = [i * 7919 for i, _ in pairs]
    sent = [s._chunk_anchors([x for _, x in pairs[a:a + 100]], keys[a:a + 100], n) for a in range(0, 400, 100)]
    docs = pa.record_batch([pa.array(keys), pa.array([x for _, x in pairs]), pa.array([i for i, _ in pairs])], names=["rk", "text", "ord"])

    def grouped(tables):
        t = pa.concat_tables([x if isinstance(x, pa.Table) else pa.Table.from_batches([x]) for x in tables])
        return {b: t.filter(pa.compute.equal(t.column("bucket"), b)) for b in set(t.column("bucket").to_pylist())}

    def largest(hot):
        shared = grouped([s._find_shared(n, hot)(t) for t in grouped(sent).values()])
        blocks = grouped(s._pack_documents(n)(iter([docs])))
        seen = grouped([s._emit_contexts(n)(blocks[b], shared[b]) for b in blocks])
        sizes = [len(s._unpacked(t, s.SEEN if b < n else s.WINDOW)) for b, t in seen.items() if b < n or b >= 2 * n]
        return max(sizes), sum(sizes)

    assert largest(1 << 30)[0] >= 300  # the contexts of an anchor in one group
    most, total = largest(100)
    assert total > 400 and most < 2 * total / n, (most, total)


def test_only_blocks_with_a_hot_anchor_hear_of_it():
    """Notices: one for each block that holds the anchor, also where one record stands for documents of many blocks."""
    n, phrase = 64, "a phrase of all, less than a window"
    pairs = [(i, x.encode()) for i, x in _surrounded(300, phrase)]
    keys = [(i % 5) * 11 + 64 * i for i, _ in pairs]  # blocks 0, 11, 22, 33, 44
    sent = [s._chunk_anchors([x for _, x in pairs[a:a + 100]], keys[a:a + 100], n) for a in range(0, 300, 100)]
    table = pa.Table.from_batches(sent)
    told = {}
    for b in set(table.column("bucket").to_pylist()):
        out = s._find_shared(n, 100)(table.filter(pa.compute.equal(table.column("bucket"), b)))
        for block in set(out.column("bucket").to_pylist()):
            rec = s._unpacked(out.filter(pa.compute.equal(out.column("bucket"), block)), s.ANCHOR)
            for name in rec["rk"][rec["pos"] == s.HOT_ANCHOR].tolist():
                told.setdefault(name, []).append(block)
    assert told and all(sorted(x) == [0, 11, 22, 33, 44] for x in told.values())
    # An anchor of every document is named alike by those who hold its bytes.
    grams = np.frombuffer(b"".join(phrase[i:i + s.GRAM].encode() for i in range(len(phrase) - s.GRAM + 1)), dtype=np.uint8)
    assert set(told) <= set(s._names(grams.reshape(-1, s.GRAM), n).tolist())


def test_many_buckets_cost_little_more_disk_than_few():
    """Anchors and documents were packed 4 MB of text at a time, whatever the number of buckets, and records bore
    the eight random bytes of a document's key: at 6 GB, with 600 buckets, a blob held a few of them."""
    r = random.Random(9)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(r.choice(words) for _ in range(400)).encode() for _ in range(4000)]
    assert sum(map(len, texts)) > 2 * s.CHUNK
    keys = [r.randrange(-1 << 63, 1 << 63) for _ in texts]
    docs = pa.record_batch([pa.array(keys), pa.array(texts), pa.array(range(len(texts)))], names=["rk", "text", "ord"])
    part = docs.select(["rk", "text"])
    assert len([*s._pack_documents(300)(iter([docs]))]) == len([*s._emit_anchors(300)(iter([part]))]) == 1
    assert len([*s._pack_documents(16)(iter([docs]))]) > 1 and len([*s._emit_anchors(16)(iter([part]))]) > 1
    block = np.array(keys, dtype=np.int64) // 600 * 600 + 7
    rec = np.zeros(len(block), dtype=s.SEEN)
    rec["rk"] = s._short(block, 600)
    assert len(set(rec["rk"].tolist())) == len(set(block.tolist())) and set((rec["rk"] % 600).tolist()) == {7}
    assert sum(len(x) for x in s._packed(np.zeros(len(rec), dtype=np.int64), rec).column("data").to_pylist()) < 4 * len(rec)


def test_numbers_come_back_from_byte_planes():
    rec = np.zeros(3, dtype=s.HIT)
    rec["rk"], rec["pos"], rec["mask"] = [-5, 1 << 40, 7], [0, 1 << 31, 2], [1, 1 << 34, 0]
    for n in (0, 1, 3):
        got = s._unpacked(pa.Table.from_batches([s._packed(np.zeros(n, dtype=np.int64), rec[:n])]), s.HIT)
        assert np.array_equal(got, rec[:n])
