import random
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tillcast.llm import sharding as s


def best(sizes, n):
    """Smallest largest run over all contiguous partitions, by dynamic programming."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    cost = np.full(len(sizes) + 1, np.inf)
    cost[0] = 0
    for _ in range(n):
        new = cost.copy()
        for j in range(1, len(sizes) + 1):
            new[j] = min(new[j], min(max(cost[i], ends[j] - ends[i]) for i in range(j)))
        cost = new
    return int(cost[-1])


def test_smallest_capacity():
    r = random.Random(1)
    for _ in range(60):
        sizes = np.array([r.randint(1, 30) for _ in range(r.randint(1, 25))])
        n = r.randint(1, 8)
        c = s.smallest_capacity(sizes, n)
        assert c == best(sizes, n)
        assert len(s.greedy(sizes, c)) <= n


def test_tree_search_equals_whole_search(spark, monkeypatch):
    monkeypatch.setattr(s, "FIRST_BITS", 4)
    monkeypatch.setattr(s, "NEXT_BITS", 2)
    r = random.Random(2)
    rows = [(r.getrandbits(64) - (1 << 63), r.randint(1, 1000)) for _ in range(400)]
    groups = spark.createDataFrame(rows, "h long, size long")
    order = sorted((h & (1 << 64) - 1, size) for h, size in rows)
    sizes = np.array([x for _, x in order])
    for n in (1, 3, 7):
        cuts = s.find_cuts(groups, n)
        want = s.greedy(sizes, s.smallest_capacity(sizes, n))
        assert [sum(h < c for h, _ in order) for c in cuts] == want[:-1]


def check(rows, texts, n):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
        assert 0 <= r["shard"] < n and r["law"] == "bytes" and r["grown_shard"] is None
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    return by


def test_query(spark, sf_dir, given):
    rows = s.op10_sharding(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == [i for i, _ in given]
    by = check(rows, given, 40)
    texts, of = dict(given), defaultdict(set)
    for r in rows:
        x = texts[r["doc_id"]].encode()
        assert r["size"] == len(x) + 16 and r["text_crc32"] == zlib.crc32(x)
        of[x].add(r["shard"])
    assert all(len(v) == 1 for v in of.values())


def test_giants_get_their_own_shards(make_docs):
    rng = random.Random(3)
    texts = ["copy " * 50] * 300 + ["".join(rng.choice("abcdef") for _ in range(200)) for _ in range(600)]
    rows = s.shard(make_docs(texts), 10).collect()
    by = check(rows, texts, 10)
    sizes = {k: sum(r["size"] for r in v) for k, v in by.items()}
    assert len(by[0]) == 300 and len({r["text_crc32"] for r in by[0]}) == 1
    rest = [v for k, v in sizes.items() if k]
    assert len(rest) == 9 and max(rest) - min(rest) < 0.1 * max(rest)


def test_odd_rows(odd_docs, empty_docs):
    rows = s.shard(odd_docs, 4).collect()
    assert len(rows) == odd_docs.count()
    check(rows, None, 4)
    nulls = [r for r in rows if r["doc_id"] in (0, 1)]
    assert {(r["size"], r["text_crc32"]) for r in nulls} == {(16, 0)} and len({r["shard"] for r in nulls}) == 1
    assert s.shard(empty_docs, 4).count() == 0


def test_written_shards(make_docs, scratch, spark):
    docs = make_docs(["a b c", "a b c", "d e", "f"])
    s.write_shards(docs, f"{scratch}/out", 2)
    back = spark.read.parquet(f"{scratch}/out")
    assert back.count() == 4 and back.select("shard").distinct().count() == 2
