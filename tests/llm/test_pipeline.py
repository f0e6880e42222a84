"""The stages of the corpus pipeline against brute force on the small documents."""

import re
from collections import defaultdict

import pytest

import corpus_pipeline as cp


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_stages_keep_columns_and_chain(spark, docs, sf_dir):
    rows = docs
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, rows, sf_dir)
        assert out.columns == docs.columns, name
        assert out.count() <= rows.count()
        rows = spark.createDataFrame(out.collect(), docs.schema)
    assert cp.run(spark, sf_dir).count() == rows.count() > 0.8 * docs.count()


def test_line_stage(spark, docs, sf_dir):
    before = {r.doc_id: r for r in docs.collect()}
    key = lambda x: re.sub(r"^[ \t-\r]+|[ \t-\r]+$", "", x).translate({c: c + 32 for c in range(65, 91)})
    holders = defaultdict(set)
    for r in before.values():
        for line in r.text.split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(r.doc_id)
    for r in cp.without_repeated_lines(spark, docs, sf_dir).collect():
        kept = [x for x in before[r.doc_id].text.split("\n") if len(holders[key(x)]) < 2 or min(holders[key(x)]) == r.doc_id]
        assert r.text == "\n".join(kept)
        assert r.n_chars == (len(r.text) if len(kept) < before[r.doc_id].text.count("\n") + 1 else before[r.doc_id].n_chars)


def test_line_stage_keeps_null_texts(spark, sf_dir):
    df = spark.createDataFrame([(1, None), (None, "a line of text here"), (2, "a line of text here\nb")], "doc_id long, text string")
    assert sorted(map(str, cp.without_repeated_lines(spark, df, sf_dir).collect())) == sorted(map(str, spark.createDataFrame([(1, None), (None, ""), (2, "a line of text here\nb")], df.schema).collect()))


def test_near_duplicate_stage(spark, docs, sf_dir):
    from tidemark.llm import simhash

    found = simhash.similar(docs).collect()
    stay = {r.component_id for r in found}
    assert {r.doc_id for r in cp.one_of_each_group(spark, docs, sf_dir).collect()} == stay


def test_benchmark_stage(spark, docs, sf_dir):
    from tidemark.llm import decontam

    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = {r.doc_id for r in decontam.contaminations(docs, bench).collect()}
    assert {r.doc_id for r in cp.without_benchmark(spark, docs, sf_dir).collect()} == {r.doc_id for r in docs.collect()} - hit


def test_clashing_columns_pass_through(spark, sf_dir):
    rows = [(1, "the quick brown fox jumps over it\nagain and again", "en", 9, "i", "d", "r"), (2, "the quick brown fox jumps over it\nother words", "en", 9, "j", "e", "s"), (None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, _id string, drops string, `row` string")
    got = {r.doc_id: r for r in cp.without_repeated_lines(spark, df, sf_dir).collect()}
    assert got[2].text == "other words" and got[2].n_chars == 11 and (got[2]._id, got[2].drops, got[2]["row"]) == ("j", "e", "s")
    assert got[1].text == rows[0][1] and got[1].n_chars == 9 and got[None].text is None
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, df, sf_dir).columns == df.columns, name


def test_near_duplicate_stage_goes_by_row(spark, sf_dir):
    """A doc_id that occurs with two texts loses only the one that is a copy; nulls and repeated rows are settled."""
    t, u = " ".join(f"word{k}" for k in range(60)), " ".join(f"other{k}" for k in range(60))
    rows = [(1, t), (2, t), (2, u), (None, t + " more"), (None, u + " x y z"), (7, "alone in the world"), (7, "alone in the world"), (8, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, map(tuple, cp.one_of_each_group(spark, df, sf_dir).collect())))
    assert got == sorted(map(str, [(1, t), (2, u), (7, "alone in the world"), (7, "alone in the world"), (8, None)]))


def test_near_duplicate_stage_equals_brute_force(spark, docs, sf_dir):
    """Of each component of exact Jaccard links over 0.8 the smallest doc_id stays."""
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)] if w else []))
    group = [r[0] for r in rows]
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and (a == b or len(a & b) >= 0.8 * len(a | b)) and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    assert sorted(r.doc_id for r in cp.one_of_each_group(spark, docs, sf_dir).collect()) == sorted(set(group))


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_stages_of_an_empty_table(spark, docs, sf_dir, name):
    assert dict(cp.STAGES)[name](spark, docs.limit(0), sf_dir).collect() == []


def test_unlike_sets_of_one_hash_are_told_apart(spark):
    from tidemark.llm import simhash

    rows = [(1, 10, 5, 7), (2, 10, 5, 7), (3, 10, 6, 7), (4, 10, 5, 8), (5, 11, 5, 7)]
    got = {r.id: r.node for r in simhash._told_apart(spark.createDataFrame(rows, "id long, node long, size long, fingerprint long")).collect()}
    assert got[1] == got[2] == 10 and got[5] == 11 and len({got[k] for k in (1, 3, 4, 5)}) == 4
    clear = spark.createDataFrame([rows[0], rows[1], rows[4]], "id long, node long, size long, fingerprint long")
    assert simhash._told_apart(clear) is clear
