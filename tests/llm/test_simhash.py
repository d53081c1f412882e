import random

import numpy as np
import xxhash

from tillcast.llm import simhash as s
from tillcast.llm.components import connected_components


def print_of(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints):
    """Least index reachable over pairs at distance 2 or less, by brute force."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    a = np.array(prints, dtype=np.uint64)
    for i in range(len(a)):
        for j in np.nonzero(np.bitwise_count(a[i + 1:] ^ a[i]) <= 2)[0]:
            x, y = find(i), find(int(i + 1 + j))
            parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def test_fingerprints(given, odd_docs):
    for _, x in given[:60]:
        assert s.fingerprint(x) == print_of(x)
    got = s.fingerprints(odd_docs).collect()
    want = [print_of(r["text"]) for r in odd_docs.select("text").collect() if r["text"] is None or len(r["text"]) < 10_000]
    assert set(want) <= {r["fp"] & (1 << 64) - 1 for r in got}


def test_links_lose_nothing(spark):
    r = random.Random(9)
    prints = set()
    for _ in range(40):  # dense neighbourhoods and chains
        x = r.getrandbits(64)
        prints.add(x)
        for _ in range(r.randint(0, 12)):
            for _ in range(r.randint(1, 3)):
                x ^= 1 << r.randrange(64)
            prints.add(x)
    prints |= {0, (1 << 64) - 1, 1, 3, 7, 1 << 63, (1 << 63) | 1}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    fps = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {x["node"]: x["root"] for x in connected_components(s.grid_links(fps)).collect()}
    mine = [roots.get(x, x) for x in signed]
    want = classes(prints)
    assert len(set(zip(mine, want))) == len(set(mine)) == len(set(want))


def test_edges_of_a_large_group_stay_linear(spark):
    base = 0x123456789ABCDEF0
    prints = {base} | {base ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)}
    fps = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    links = s.grid_links(fps)
    assert links.count() <= 65 * len(prints)
    roots = connected_components(links)
    assert roots.select("root").distinct().count() == 1 and roots.select("node").distinct().count() == len(prints)


def test_query_equals_brute_force(spark, sf_dir, given):
    got = {r["doc_id"]: r for r in s.op7_simhash(spark, sf_dir).collect()}
    prints = [print_of(x) for _, x in given]
    want = classes(prints)
    assert len(got) == len(given)
    for k, (i, _) in enumerate(given):
        assert got[i]["fingerprint"] == f"{prints[k]:016x}"
        assert got[i]["component_id"] == given[want[k]][0]


def test_odd_rows_and_keeping_one(odd_docs, make_docs):
    got = s.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    zero = {(r["doc_id"], r["component_id"]) for r in got if r["fp"] == 0}
    assert {(0, 0), (1, 0), (2, 0)} <= zero
    text = " ".join(f"word{i}" for i in range(300))
    docs = make_docs([(5, text), (2, text), (9, text.upper()), (7, "something else entirely " * 5)])
    kept = s.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 7]


def test_keeping_one_of_repeated_and_null_ids(make_docs):
    a, b, c, d = (" ".join(f"{w}{i}" for i in range(200)) for w in ("ant", "bee", "cat", "dog"))
    docs = make_docs([(1, a), (1, a), (1, a.upper()), (8, a),  # repeated rows of the least id
                      (None, b), (None, b), (None, b.upper()),  # no id at all
                      (None, c), (6, c),                        # a null id beside an id
                      (4, d), (1, d), (1, d)])                  # id 1 is least here as well
    kept = [(r["doc_id"], r["text"].lower()) for r in s.keep_one(docs).collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (None, b), (6, c), (1, d)], key=str)


def test_keeping_one_text_of_an_id_that_is_not_least_there(make_docs):
    a, b = (" ".join(f"{w}{i}" for i in range(200)) for w in ("ant", "bee"))
    kept = s.keep_one(make_docs([(5, a), (2, b), (5, b)])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(2, b), (5, a)]


def test_empty_table(empty_docs):
    assert s.near_duplicates(empty_docs).count() == 0
    assert s.keep_one(empty_docs).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "u long, v long")
    got = connected_components(edges).collect()
    assert {r["root"] for r in got} == {0} and {r["node"] for r in got} == set(range(201))
