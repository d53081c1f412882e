import re

import duckdb

from tillcast.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = WORD.findall(text or "")
    seen, covered = {}, set()
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i:i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {i + k for i in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_measures_match_brute_force(odd_docs, given, make_docs):
    for docs in (odd_docs, make_docs(given)):
        texts = docs.select("doc_id", "text").collect()
        got = q.quality_rules(docs).collect()
        key = lambda r: tuple((x is not None, x) for x in r)
        want = sorted([(r["doc_id"], *brute(r["text"])) for r in texts], key=key)
        have = sorted([(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got], key=key)
        assert have == want
        for r in got:
            assert r["base_failed"] == (r["n_words"] < 50 or 2 * r["n_repeat_words"] > r["n_words"])
            assert not (r["kept"] and r["base_failed"])


def test_query_matches_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    have = q.op1_quality_rules(spark, sf_dir).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = con.execute(q.oracle_sql()).df().sort_values("doc_id").reset_index(drop=True)
    assert have.equals(want[have.columns])


def test_plan_is_native(spark, sf_dir):
    plan = q.op1_quality_rules(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_keeps_good_rejects_bad(spark, sf_dir):
    kept = q.op1_quality_rules(spark, sf_dir).filter("n_words >= 50")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = {r["quality"]: (r["n"], r["k"]) for r in kept.join(labels, "doc_id").groupBy("quality").agg(
        {"kept": "count", "doc_id": "count"}).selectExpr("quality", "`count(kept)` n", "`count(doc_id)` k").collect()}
    assert good
    wrong = kept.join(labels, "doc_id").filter("kept != (quality = 1) AND NOT base_failed").count()
    assert wrong == 0


def test_empty_table(empty_docs):
    assert q.quality_rules(empty_docs).count() == 0
