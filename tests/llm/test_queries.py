"""The registered queries over the smallest tables: against DuckDB where there is SQL, else against plain Python."""

import hashlib
import json
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

from tidemark.llm import decontam, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    cursor = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    df = queries.queries()[name](spark, sf_dir)
    cols = sorted(names)
    assert cols == sorted(df.columns)
    want = sorted(str([r[names.index(c)] for c in cols]) for r in cursor.fetchall())
    assert sorted(str([r[c] for c in cols]) for r in df.collect()) == want


def test_op1(spark, sf_dir, docs):
    def fingerprint(text):
        w = WORD.findall((text or "").encode().lower().decode())
        s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    f = {d: fingerprint(r.text) for d, r in docs.items()}
    group = {d: d for d in f}
    ids = sorted(f)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (f[a] ^ f[b]).bit_count() <= 2 and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in queries.simhash_near_dedup(spark, sf_dir).collect()}
    assert got == {(d, f"{f[d]:016x}", group[d]) for d in f}


def test_op2(spark, sf_dir, docs, tokenizer):
    want = set()
    for d, r in docs.items():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        want.add((d, len(ids), sha(",".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))))
    assert set(map(tuple, queries.bpe_round_trip(spark, sf_dir).collect())) == want


def test_op6(spark, sf_dir, docs, tokenizer):
    at, want = 0, set()
    for d in sorted(docs):
        ids = [*tokenizer.encode(docs[d].text or "", add_special_tokens=False).ids, 2]
        want.add((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert set(map(tuple, queries.token_files(spark, sf_dir).collect())) == want


def test_op7(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    role = {(r.conv_id, r.turn): r.role for r in rows}
    got = {(r.conv_id, r.turn): r for r in queries.chat_messages(spark, sf_dir).collect()}
    assert got.keys() == role.keys()
    level = {}
    for conv, turn in sorted(k for k, x in role.items() if x == "user"):
        level[conv, turn] = max((2 + level[conv, p] for p in (turn - 1, turn - 2) if turn >= 2 and (conv, p) in level), default=0)
    assert max(level.values()) >= 6
    for r in rows:
        g, m = got[r.conv_id, r.turn], json.loads(got[r.conv_id, r.turn].message)
        if r.role == "user":
            status = "linked" if role.get((r.conv_id, r.turn + 1)) == "assistant" else "open"
            arguments = {"prompt": r.text} | ({"turn": r.turn} if r.turn >= 2 else {})
            assert m["tool_calls"] == [{"arguments": arguments, "id": f"{r.conv_id}-{r.turn}", "name": "follow_up" if r.turn >= 2 else "ask"}] and m["content"] is None
            assert g.problems == "" and (g.root_turn, g.level) == (r.turn, level[r.conv_id, r.turn])
        elif r.role == "assistant":
            status = "linked" if role.get((r.conv_id, r.turn - 1)) == "user" else "orphan"
            assert m == {"content": r.text, "role": "assistant", "tool_call_id": f"{r.conv_id}-{r.turn - 1}"}
            assert (g.root_turn, g.level) == ((r.turn - 1, level[r.conv_id, r.turn - 1] + 1) if status == "linked" else (r.turn, 0))
        else:
            status = "plain"
            assert m == {"content": r.text, "role": r.role}
        assert g.status == status and g.message == json.dumps(m, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_op8(spark, sf_dir, docs):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    want = set()
    for d, r in docs.items():
        text = decontam.normal(r.text or "")
        for i in items:
            whole = decontam.normal(i.text)
            last = max(0, len(whole) - decontam.SEGMENT)
            if any(whole[a : a + decontam.SEGMENT] in text for a in {*range(0, last, decontam.SEGMENT // 2), last}):
                want.add((d, i.item_id))
    got = {(r.doc_id, r.item_id): r.edits for r in queries.decontamination(spark, sf_dir).collect()}
    assert want <= got.keys() and want  # verbatim passages; others only within the edits
    assert all(e > 0 for k, e in got.items() if k not in want)


def test_op9(spark, sf_dir, docs):
    got = {r.doc_id: r for r in queries.language_id(spark, sf_dir).collect()}
    langs = {r.lang for r in docs.values()}
    assert got.keys() == docs.keys()
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.lang_pred in langs | {"und"}
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in docs[d].text or ""))
