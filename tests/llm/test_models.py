import zlib

import numpy as np
from pyspark.sql import functions as F

from tillcast.llm import quality_classifier as q
from tillcast.llm import toxicity as x

SF = "/root/testdata/sf0.01"


def test_label_model_recovers_accuracies():
    g = np.random.default_rng(0)
    n, good = 20_000, 0.8
    truth = g.random(n) < good
    accuracy = np.array([0.95, 0.85, 0.75, 0.9])
    right = g.random((n, 4)) < accuracy
    votes = np.where(right == truth[:, None], q.GOOD, q.BAD)
    votes[g.random((n, 4)) < 0.3] = q.ABSTAIN
    patterns, counts = np.unique((votes * 3 ** np.arange(4)).sum(axis=1), return_counts=True)
    model = q.estimate(patterns, counts, 4)
    assert abs(model.prior - good) < 0.05
    assert np.abs(model.accuracies() - accuracy).max() < 0.06
    assert abs(model.posterior(np.array([0]))[0] - model.prior) < 1e-9  # nobody votes: the prior


def test_label_model_without_rows():
    model = q.estimate(np.zeros(0, dtype=np.int64), np.zeros(0), 3)
    assert model.prior == 0.5


def test_scorer_learns_and_empty_texts_score_zero():
    good = [f"the cat and dog {i} of the house is in a garden".encode() for i in range(60)]
    bad = [f"buy!! CHEAP!! now!! {i} CLICK!! $$$ WIN!!".encode() for i in range(60)]
    scorer = q.fit(good + bad, np.array([1.0] * 60 + [0.0] * 60))
    p = scorer.scores([b"the dog of the house is in a garden and the cat", b"CHEAP!! WIN!! CLICK!! $$$ now!!", b"", b" \n"])
    assert p[0] > 0.5 > p[1] and p[2] == p[3] == 0
    assert q.fit([], np.zeros(0)).scores([b"a"])[0] == 0.5


def test_classifier_against_labels(spark):
    got = q.op3_quality_classifier(spark, SF)
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = got.collect()
    assert len(rows) == docs.count()
    verdict = {r["doc_id"]: r["kept"] for r in rows}
    marks = [(r["quality"], verdict[r["doc_id"]]) for r in labels.collect()]
    assert np.mean([k for m, k in marks if m == 1]) >= 0.99
    assert np.mean([not k for m, k in marks if m == 0]) >= 0.9


def test_classifier_odd_rows_and_columns(odd_docs, empty_docs):
    got = q.classify(odd_docs)
    rows = got.collect()
    assert len(rows) == odd_docs.count()
    assert all(r["score"] == 0 and not r["kept"] for r in rows if not (r["row"]["text"] or "").split())
    assert len({r["score"] for r in rows if r["row"]["doc_id"] == 3}) == 1
    assert q.keep_good(odd_docs).columns == odd_docs.columns
    assert q.classify(empty_docs).count() == 0


def test_gradients_match_differences():
    texts = [b"one two three four five six", b"seven one nine", b"ten eleven two"]
    words, net, rng = x.Words(texts), x.Network(), np.random.default_rng(1)
    text, start, sizes = words.windows()
    at = np.minimum(start[:, None] + np.arange(x.WINDOW), len(words.number) - 1)
    y = np.array([1.0, 0, 1], dtype=np.float32)
    state = rng.bit_generator.state

    def loss():
        which, inverse = np.unique(words.number[at], return_inverse=True)
        inputs = net.inputs(words, which)[0]
        rng.bit_generator.state = state
        inputs[:, :x.WORD_DIM] *= (rng.random(len(which)) > 0.3).astype(np.float32)[:, None]
        p = x._sigmoid(net.logits(net.table(inputs).astype(np.float64), inverse.reshape(at.shape), sizes))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    rng.bit_generator.state = state
    g = net.gradients(words, words.number[at], sizes, y, rng)
    for name in ("wx", "wh", "b", "u", "v", "c"):
        value = getattr(net, name).reshape(-1)
        for k in np.random.default_rng(3).integers(0, value.size, 4):
            old = value[k]
            value[k] = old + 1e-2
            up = loss()
            value[k] = old - 1e-2
            down = loss()
            value[k] = old
            assert abs((up - down) / 2e-2 - g[name].reshape(-1)[k]) < 2e-3


def test_windows_cover_whole_texts():
    words = x.Words([b"w " * 100, b"", b"one"])
    text, start, sizes = words.windows()
    covered = set()
    for t, a, n in zip(text, start, sizes):
        if t == 0:
            covered |= set(range(a, a + n))
    assert covered == set(range(100)) and 1 not in text and (sizes[text == 2] == [1]).all()


def test_held_out_rows_are_not_learnt(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    texts, _ = x.sample(docs, labels)
    out = {r["text"].lower().encode() for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    learnt = {r["text"].lower().encode() for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2}
    assert not (set(texts) & (out - learnt)) and len(texts) > 100


def test_toxicity_query(spark):
    rows = {r["doc_id"]: r for r in x.op9_toxicity(spark, SF).collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert rows.keys() == docs.keys()
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.3)
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(labels[i], r["predicted"]) for i, r in rows.items() if r["held_out"] and i in labels]
    toxic, clean = [b for a, b in held if a == 1], [b for a, b in held if a == 0]
    assert np.mean([a == b for a, b in held]) >= 0.85
    assert np.mean(toxic) >= 0.4 and np.mean(clean) <= 0.05  # 14 toxic documents; see the test on more rows


def test_toxicity_of_odd_rows(spark, odd_docs, empty_docs):
    texts = [b"you idiot scum go away", b"a fine day in the garden"] * 20
    net = x.train(texts, np.array([1, 0] * 20), steps=60)
    got = x.score(odd_docs, net).collect()
    assert len(got) == odd_docs.count()
    assert all(r["score"] == 0 and r["n_windows"] == 0 for r in got if r["doc_id"] in (0, 1, 2))
    assert all(r["n_windows"] > 1000 for r in got if r["doc_id"] == 5)
    assert x.score(empty_docs, net).count() == 0
    a, b = x.score(spark.createDataFrame([(1, texts[0].decode()), (2, texts[1].decode())], "doc_id long, text string"), net).orderBy("doc_id").collect()
    assert a["score"] > 0.3 > b["score"]
    assert x.train([], np.zeros(0)).scores(x.Words([b"a"]), np.zeros(1, int), np.ones(1, int))[0] < 0.1


def test_toxic_and_clean_held_out_documents_apart(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(labels[r["doc_id"]], r["predicted"]) for r in x.op9_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    toxic, clean = [b for a, b in held if a == 1], [b for a, b in held if a == 0]
    assert len(toxic) > 100 and len(clean) > 500
    assert np.mean(toxic) >= 0.8 and np.mean(clean) <= 0.03


def test_repeated_ids_do_not_depend_on_partitions(spark):
    """Rows that repeat an id with different texts: the sample takes the text of the least hash, however the rows lie."""
    rows = [(i % 30, f"text {i} of many words and {'idiot scum ' * (i % 3)} 12 {i * i}", i) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    got = []
    for n in (1, 2, 5):
        part = docs.repartition(n, "n").orderBy(F.rand(n))
        texts, y = x.sample(part, labels)
        model, scorer = q.train(part.select("doc_id", "text"))
        got.append((texts, y.tolist(), scorer.bias, scorer.weights.tolist()))
    assert got[0] == got[1] == got[2] and len(got[0][0]) == len(set(got[0][0]))


def plain_score(net, text):
    """Highest window score of a text, word by word in plain loops."""
    words = x.Words([text])
    _, start, sizes = words.windows()
    ends = np.cumsum(words.count)

    def vector(number):
        grams = words.grams[ends[number] - words.count[number]:ends[number]]
        chars = np.sum([net.char[g] for g in grams], axis=0) / len(grams) ** 0.5 if len(grams) else np.zeros(net.char.shape[1])
        return np.concatenate([net.word[words.word[number]], chars]).astype(float)

    def run(inputs, d):
        h, out, k = np.zeros(x.HIDDEN), [], x.HIDDEN
        for v in inputs:
            gx, gh = v @ net.wx[d] + net.b[d, 0], h @ net.wh[d]
            z, r = (1 / (1 + np.exp(-(gx[i * k:(i + 1) * k] + gh[i * k:(i + 1) * k]))) for i in (0, 1))
            h = z * h + (1 - z) * np.tanh(gx[2 * k:] + r * gh[2 * k:])
            out.append(h)
        return out

    best = 0.0
    for a, n in zip(start, sizes):
        inputs = [vector(words.number[i]) for i in range(a, a + n)]
        states = [np.concatenate(p) for p in zip(run(inputs, 0), run(inputs[::-1], 1)[::-1])]
        e = np.exp([s @ net.u for s in states])
        pooled = sum(w * s for w, s in zip(e / e.sum(), states))
        best = max(best, 1 / (1 + np.exp(-(pooled @ net.v + net.c[0]))))
    return best


def test_scores_equal_plain_loops(spark):
    texts = ["you idiot scum go away", "a fine day in the garden", "x " * 300 + "idiot scum " * 5 + "y " * 77, "one", ""]
    net = x.train([t.encode() for t in texts[:2]] * 20, np.array([1, 0] * 20), steps=60)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in x.score(docs, net).collect()}
    for i, t in enumerate(texts):
        assert abs(got[i] - plain_score(net, t.encode())) < 1e-4, t[:40]
