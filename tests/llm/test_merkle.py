"""Merkle manifest against a tree built in plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tillcast.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode("utf-8", "surrogatepass")).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode('utf-8', 'surrogatepass'))}:{v}"


def levels(nodes, arity):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i:i + arity]) for i in range(0, len(out[-1]), arity)])
    return out


def brute(rows, fields, arity=2, edit=False):
    """Sorted (id, leaf, subroot, root, proof, folded root) of dict rows."""
    leaf = lambda r, n: H(*[field(n if f == "n_chars" else r[f]) for f in fields])
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["n_chars"])))
    trees = {g: levels([leaf(r, r["n_chars"]) for r in groups[g]], arity) for g in names}
    top = levels([trees[g][-1][0] for g in names], arity)
    out = []
    for gi, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            n = r["n_chars"]
            if edit and n is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0:
                n += 1
            acc, proof = leaf(r, n), []
            for tree, at in ((trees[g], i), (top, gi)):
                for level in tree[:-1]:
                    a = at // arity * arity
                    run = level[a:a + arity]
                    before, after = run[:at - a], run[at - a + 1:]
                    proof += before + after
                    acc = H(*before, acc, *after)
                    at //= arity
            out.append((r["doc_id"], leaf(r, r["n_chars"]), trees[g][-1][0], top[-1][0], H(*proof), acc))
    return sorted(out, key=str)


def digests(m):
    rows = m.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")),
                    merkle.folded(F.coalesce("edited_leaf", "leaf"), F.col("path"))).collect()
    return sorted(map(tuple, rows), key=str)


def test_query_on_given_documents(spark, sf_dir):
    rows = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = merkle.op11_merkle_manifest(spark, sf_dir).collect()
    want = brute(rows, merkle.FIELDS, edit=True)
    assert sorted([tuple(r)[:6] for r in got], key=str) == want
    assert all(r["verified"] == (r["folded_root"] == r["root"]) for r in got)
    broken = {r["doc_id"] for r in got if not r["verified"]}
    assert broken == {r["doc_id"] for r in rows if r["n_chars"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0}


@pytest.mark.parametrize("arity, depth", [(2, 1), (2, 3), (3, 2)])
def test_blocks_and_tiers(spark, make_docs, arity, depth):
    """Blocks far smaller than the groups: several tiers, runs cut short, one hot group."""
    rows = [(i, f"t{i}", "hot" if i % 3 else (None if i % 2 else f"g{i % 5}"), None, i) for i in range(97)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = digests(merkle.manifest(docs, arity=arity, levels=depth))
    assert got == brute([r.asDict() for r in docs.collect()], merkle.FIELDS, arity)


def test_many_groups(spark):
    docs = spark.createDataFrame([(i, f"é{i}", f"l{i:03}", "s", 1) for i in range(70)], "doc_id long, text string, lang string, source string, n_chars long")
    assert digests(merkle.manifest(docs, levels=2)) == brute([r.asDict() for r in docs.collect()], merkle.FIELDS)


def test_odd_rows(odd_docs):
    """Nulls, repeated rows and ids, an empty and a very long text, clashing columns."""
    m = merkle.manifest(odd_docs, edited={"n_chars": F.when(F.col("doc_id") == 3, F.lit("99"))})
    assert sorted([r[:5] for r in digests(m)], key=str) == [r[:5] for r in brute([r.asDict() for r in odd_docs.collect()], merkle.FIELDS)]
    wrong = m.filter(merkle.folded(F.coalesce("edited_leaf", "leaf"), F.col("path")) != F.col("root"))
    assert [r["doc_id"] for r in wrong.collect()] == [3, 3]


def test_one_row_and_empty(make_docs, empty_docs):
    (r,) = merkle.manifest(make_docs(["alone"])).collect()
    assert r["leaf"] == r["subroot"] == r["root"] and r["path"] == []
    assert merkle.manifest(empty_docs).count() == 0
