"""Every stage of the pipeline against a brute-force version on the stage's own input."""

import hashlib

import pytest
from test_bpe_and_counts import library
from test_decontaminate import brute as contaminated
from test_simhash import classes, print_of
from test_suffix_dedup import brute as cut

import corpus_pipeline
from tillcast.llm import quality_classifier as q

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.fixture(scope="module")
def stages(spark, sf_dir, given, tmp_path_factory):
    """Input and result rows of each stage of one run."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    item = max((r["text"] for r in bench.collect() if r["text"]), key=lambda x: len(x.split()))
    good = [t for _, t in given if 300 < len(t or "") < 4000][:60]
    passage = "the shared passage of this test goes on for a good while, and then a little more than that, é to the end. "
    texts = list(given) + [(5000 + i, t) for i, t in enumerate(good[:8])]
    texts += [(6000 + i, t + " " + passage) for i, t in enumerate(x[::-1][:200] + x for x in good[8:16])]
    texts += [(6100 + i, t[:250] + " " + passage + t[250:500]) for i, t in enumerate(good[16:24])]
    texts += [(7000 + i, t[:200] + " " + item) for i, t in enumerate(good[24:30])]
    texts += [(8000, None), (8001, ""), (8002, " "), (None, good[30][:300]), (None, None)]
    texts += [(9000, good[31][50:400] + passage)] * 3  # repeated rows
    path = str(tmp_path_factory.mktemp("pipeline"))
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in texts]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    bench.write.parquet(f"{path}/benchmark.parquet")
    seen, was = {}, corpus_pipeline.STAGES

    def watched(name, stage):
        def run(spark, docs, sf_dir):
            out = stage(spark, docs, sf_dir)
            seen[name] = docs, docs.collect()
            return out
        return name, run

    corpus_pipeline.STAGES = [watched(*x) for x in was]
    try:
        last = corpus_pipeline.run(spark, path).collect()
    finally:
        corpus_pipeline.STAGES = was
    names = [n for n, _ in was]
    out = {n: seen[m][1] for n, m in zip(names, names[1:])} | {names[-1]: last}
    return {n: (*seen[n], out[n]) for n in names}, [(r["item_id"], r["text"]) for r in bench.collect()]


def test_order_and_columns(stages):
    assert list(stages[0]) == ["quality", "near_duplicates", "substrings", "decontamination", "tokens"]
    for name in list(stages[0])[:-1]:
        docs, rows, out = stages[0][name]
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert rows and out and all(r.asDict().keys() == rows[0].asDict().keys() for r in out)


def test_quality(stages):
    docs, rows, out = stages[0]["quality"]
    scorer = q.train(docs)[1]  # texts scored one at a time
    want = [r for r in rows if scorer.scores([(r["text"] or "").encode()])[0] >= q.THRESHOLD]
    assert ordered(out) == ordered(want) and len(out) < len(rows)
    assert all((r["text"] or "").strip() for r in out)


def test_near_duplicates(stages):
    _, rows, out = stages[0]["near_duplicates"]
    last = 1 << 63
    rows = sorted(rows, key=lambda r: last if r["doc_id"] is None else r["doc_id"])
    first = {}
    for r, c in zip(rows, classes([print_of(r["text"]) for r in rows])):
        first.setdefault(c, r)
    assert ordered(out) == ordered(first.values()) and len(out) < len(rows)


def test_substrings(stages):
    _, rows, out = stages[0]["substrings"]
    want = []
    for r, x in zip(rows, cut([(r["doc_id"], r["text"]) for r in rows])):
        kept = x[4].decode(errors="ignore")
        want.append((r["doc_id"], kept, r["lang"], r["source"], len(kept)))
    assert ordered(out) == ordered(want) and ordered(out) != ordered(rows)


def test_decontamination(stages):
    _, rows, out = stages[0]["decontamination"]
    want = [r for r, x in zip(rows, contaminated([(r["doc_id"], r["text"]) for r in rows], stages[1])) if not x[5]]
    assert ordered(out) == ordered(want) and len(out) < len(rows)


def test_tokens(stages):
    _, rows, out = stages[0]["tokens"]
    t, want = library(), []
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in rows:
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), ids, sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    assert ordered(out) == ordered(want)
