import hashlib
import random
import re

import numpy as np

from tillcast.llm import decontaminate as d
from tillcast.llm.fm_index import FMIndex, suffix_order

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for k, t in items:
        w = words(t)
        for j in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[j:j + 13]), set()).add(k)
    out = []
    for i, t in docs:
        w = words(t)
        hit, found = [0] * len(w), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[j:j + n]))) is not None:
                    found |= x
                    hit[j:j + n] = [1] * n
        names = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), sum(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(),
                    sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return out


def test_query_equals_brute_force(spark, sf_dir, given):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = sorted(tuple(r) for r in d.op6_decontamination(spark, sf_dir).collect())
    want = sorted(brute(given, items))
    assert got == want and any(r[2] for r in got)


def found(docs, bench, **options):
    rows = d.find_benchmark(docs, bench, **options).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted([(r["row"]["doc_id"], r["n_words"], r["n_hit"], len(r["items"]),
                    hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r["contaminated"]) for r in rows], key=key), rows


def test_small_items_blocks_and_odd_rows(spark, make_docs, odd_docs, odd_rows):
    r = random.Random(8)
    vocabulary = ["alpha", "Beta", "gamma9", "délta", "eps", "漢字"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(k, text(r.choice([1, 2, 3, 13, 14, 30]))) for k in range(12)] + [(20, None), (21, ""), (22, "!!"), (3, "same item"), (3, "same item"), (None, "no id here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(i, text(r.randint(0, 60)) + r.choice(["", " x ", "same item"])) for i in range(40)] + [(40, items[4][1])]
    want = sorted(brute(docs, items), key=lambda x: x[0])
    assert found(make_docs(docs), bench)[0] == want
    assert found(make_docs(docs), bench, block_bytes=60)[0] == want
    key = lambda r: tuple((x is not None, x) for x in r)
    assert found(odd_docs, bench)[0] == sorted(brute(odd_rows, items), key=key)


def test_spans_and_keeping(spark, make_docs):
    passage = " ".join(f"w{i}" for i in range(20))
    docs = make_docs([(1, "before " + passage.upper() + ", after"), (2, "clean text here"), (3, "x " * 1000 + passage)])
    bench = spark.createDataFrame([(7, passage)], "item_id long, text string")
    rows = {r["row"]["doc_id"]: r for r in found(docs, bench)[1]}
    assert (rows[1]["starts"], rows[1]["ends"]) == ([1], [21])
    assert (rows[1]["byte_starts"], rows[1]["byte_ends"]) == ([7], [7 + len(passage)])
    kept = d.keep_clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3]  # 20 of 1020 words is below a twentieth


def test_empty_tables(spark, empty_docs, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.find_benchmark(empty_docs, none).count() == 0
    assert [r["n_hit"] for r in d.find_benchmark(make_docs(["a b c"]), none).collect()] == [0]


def test_index_finds_every_occurrence():
    g = np.random.default_rng(6)
    for _ in range(40):
        symbols = np.concatenate([[0], g.integers(0, 4, int(g.integers(5, 200))), [0]])
        index = FMIndex(symbols, 4)
        phrases = g.integers(1, 4, (20, 4))
        lengths = g.integers(1, 5, 20)
        low, high = index.search(phrases, lengths)
        for p, n, a, b in zip(phrases, lengths, low, high):
            want = [i for i in range(len(symbols) - n + 1) if (symbols[i:i + n] == p[:n]).all()]
            assert sorted(index.locate(np.arange(a, max(a, b)))) == want


def test_suffix_order_with_own_terminators():
    s = np.array([0, 2, 1, 0, 2, 1, 0])
    order = suffix_order(s)
    text = [(-10 + i if x == 0 else x) for i, x in enumerate(s)]
    assert list(order) == sorted(range(len(s)), key=lambda i: text[i:])


def thue_morse(n, letters="ab"):
    out = [0]
    while len(out) < n:
        out += [1 - x for x in out]
    return "".join(letters[x] for x in out)


def test_words_with_equal_hashes(spark, make_docs):
    """Two benchmark words that share a hash are told apart at the found places."""
    a, b = thue_morse(1024), thue_morse(1024, "ba")
    items = [(1, a), (2, b), (3, f"{a} x"), (4, f"{b} x")]
    docs = [(1, f"{a} y"), (2, f"y {b}"), (3, f"{a} x {b} x"), (4, "y x")]
    got, _ = found(make_docs(docs), spark.createDataFrame(items, "item_id long, text string"))
    assert got == brute(docs, items) and [r[3] for r in got] == [1, 1, 4, 0]


def test_blocks_are_given_back(spark, make_docs, monkeypatch):
    """Fifty blocks: the driver holds the windows of two at most."""
    items = [(k, " ".join(f"w{k}x{j}" for j in range(14))) for k in range(400)]
    docs = [(i, f"a {items[7 * i][1]} b") for i in range(20)]
    held, most = set(), []
    send = spark.sparkContext.broadcast

    def counted(value):
        out = send(value)
        if isinstance(value, d.Windows):
            held.add(id(out))
            most.append(len(held))
            give = out.destroy
            out.destroy = lambda *x: (held.discard(id(out)), give(*x))
        return out

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: counted(value) if isinstance(value, d.Windows) else send(value))
    bench = spark.createDataFrame(items, "item_id long, text string")
    size = sum(len(t) + 16 for _, t in items)
    assert found(make_docs(docs), bench, block_bytes=-(-size // 50))[0] == brute(docs, items)
    assert len(most) == 50 and max(most) <= 2
