"""The Merkle manifest against a tree built in plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from threadloom.llm import merkle


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute(rows, fanout):
    """rows: (doc_id, source, lang, n_chars, text)."""

    def said(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([digest("".join(out[-1][k : k + fanout])) for k in range(0, len(out[-1]), fanout)])
        return out

    def path(tree, i):
        out = []
        for row in tree[:-1]:
            k = i // fanout * fanout
            out.append(("".join(row[k:i]), "".join(row[i + 1 : k + fanout])))
            i //= fanout
        return out

    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0], digest("".join(map(said, r))), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1]))
    trees = {s: levels([x[1] for x in by[s]]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    out = []
    for j, s in enumerate(sources):
        for i, (doc, own, r) in enumerate(by[s]):
            proof, fold = path(trees[s], i) + path(top, j), own
            if doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0 and r[4] is not None:
                fold = digest("".join(map(said, (*r[:4], r[4].encode().lower().decode()))))
            for before, after in proof:
                fold = digest(before + fold + after)
            out.append((doc, own, trees[s][-1][0], top[-1][0], digest("".join(a + b for a, b in proof)), fold, fold == top[-1][0]))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def sourced(docs):
    """docs with sources of one row, of some and of most, one of them null; names that the operator uses inside as columns."""
    k = F.pmod(F.coalesce("doc_id", F.lit(-1)), F.lit(9))
    source = F.when(k == 0, None).when(k == 1, "é").when(k == 2, "").when(F.col("doc_id") == 33, "alone").otherwise("src")
    return docs.withColumn("source", source).withColumns({c: F.lit(c) for c in ("tree", "place", "digest", "below", "before", "root", "n")})


def test_tampering(sourced, empty):
    rows = [tuple(r) for r in sourced.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = sorted((tuple(r) for r in merkle.tampering(sourced).collect()), key=repr)
    assert got == brute(rows, 16)
    assert any(r[6] for r in got) and not all(r[6] for r in got)
    assert merkle.tampering(empty).count() == 0
    assert merkle.tampering(sourced.where("doc_id = 33")).first()["proof_sha256"] == digest("")


@pytest.mark.parametrize(("fanout", "levels"), [(2, 2)])
def test_many_rounds(sourced, fanout, levels):
    """Small buckets, so that trees take several rounds, and sources are a tree of several buckets too."""
    many = sourced.withColumn("source", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("s"), F.col("doc_id") % 10)).otherwise(F.col("source")))
    rows = [tuple(r) for r in many.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    found = merkle.manifest(many, fanout=fanout, levels=levels)
    assert found.columns == ["doc_id", "source", "leaf", "subroot", "root", "proof"]
    ok = found.withColumn("ok", merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")).collect()
    assert len(ok) == len(rows) and all(r["ok"] for r in ok)
    want = {(r[0], *r[1:5]) for r in brute(rows, fanout)}
    assert {(r["doc_id"], r["leaf"], r["subroot"], r["root"], digest("".join(p["before"] + p["after"] for p in r["proof"]))) for r in ok} == want
