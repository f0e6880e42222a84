"""The Merkle manifest against plain recursion, and its versions against trees built anew."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, digest string, pos long, block string"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def lower(text):
    return text if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def tampered(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def tree(nodes):
    """All levels of the tree."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][k : k + 16])) for k in range(0, len(out[-1]), 16)])
    return out


def way(levels, k):
    """The siblings of leaf k, level by level, as (left, right)."""
    out = []
    for nodes in levels[:-1]:
        first = k // 16 * 16
        out.append(("".join(nodes[first:k]), "".join(nodes[k + 1 : first + 16])))
        k //= 16
    return out


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is None, r[0] or 0, leaf(r)))
    trees = {s: tree([leaf(r) for r in groups[s]]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for i, s in enumerate(order):
        for k, r in enumerate(groups[s]):
            steps = way(trees[s], k) + way(top, i)
            folded = leaf((*r[:4], lower(r[4]))) if tampered(r[0]) else leaf(r)
            for left, right in steps:
                folded = h(left + folded + right)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], h("".join(a + b for a, b in steps)), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def found(spark, rows, levels):
    df = spark.createDataFrame([(*r, "t", "d", 3, "b") for r in rows], SCHEMA).repartition(3)
    leaves = merkle.leaves(df, COLUMNS, {"text": merkle.lowered(F.col("text"))}, F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    return merkle.manifest(leaves, levels)


def as_rows(made):
    return sorted(map(tuple, made.rows.select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def sample(n_hot, n_sources):
    rng = random.Random(4)
    rows = [(k, "hot", "en", k % 7 or None, rng.choice(["Text", "text", "", None, "ÉÀ Zoo", "x" * 5000])) for k in range(n_hot)]
    rows += [(n_hot + k, f"s{k % n_sources}", None, 1, f"A{k}") for k in range(2 * n_sources)]
    rows += [(None, None, None, None, None), (5, None, "a", 1, "B"), (5, None, "a", 1, "B"), (5, None, "a", 1, "b"), (None, "hot", "", 0, "Q"), (-3, "", "é", 2, "日本 A"), (2**62, "alone", "de", 1, "W")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("levels", [1, 3])
def test_manifest(spark, levels):
    rows = sample(300, 20)
    assert as_rows(found(spark, rows, levels)) == expected(rows)


@pytest.mark.parametrize("n", [0, 1, 16, 17])
def test_small_trees(spark, n):
    rows = [(k, "s", "en", 1, "Ab") for k in range(n)]
    assert as_rows(found(spark, rows, 1)) == expected(rows)


def test_versions_share_all_but_the_path(spark):
    rows = [r for r in sample(260, 18) if r[0] is not None and r[0] != 5]
    made = found(spark, rows, 1)
    base, copies = made.base.cache(), merkle.versions(made).cache()
    assert {r.version for r in copies.select("version").distinct().collect()} == {r[0] for r in rows if tampered(r[0])}
    for version in [r[0] for r in rows if tampered(r[0])][:3]:
        altered = [(*r[:4], lower(r[4])) if r[0] == version else r for r in rows]
        groups = {}
        for r in sorted(altered):
            groups.setdefault(r[1], []).append(leaf(r))
        want = {("1" + s, k, j, d) for s, leaves in groups.items() for k, nodes in enumerate(tree(leaves)) if k for j, d in enumerate(nodes)}
        want |= {(None, k, j, d) for k, nodes in enumerate(tree([tree(groups[s])[-1][0] for s in sorted(groups)])) if k for j, d in enumerate(nodes)}
        assert set(map(tuple, merkle.at_version(base, copies, version).collect())) == want
        # one node a level and no other
        own = copies.where(F.col("version") == version).groupBy("tree", "level").count().collect()
        assert own and all(r["count"] == 1 for r in own)
