"""Every operator against a plain Python version, on the small documents and on rows made to be awkward."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tidemark.llm import bpe, chat, decontam, exact, langid, linededup, queries, simhash, substring, tokenstore, urlfilter
from tidemark.llm.common import new_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, n long, `key` int, _text string, ids string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def awkward():
    """Nulls, empty and long texts, ties, repeated rows, white space of all kinds."""
    rng = random.Random(5)
    words = ["alpha", "Beta", "gámma", "δelta", "e", "İ", "日本", "x" * 50, "<|endoftext|>", "it's", "1234", "--"]
    passage = " ".join(rng.choice(words) + str(k) for k in range(45))
    texts = [None, "", " ", "\n", "\t\x0b\x0c\r\n ", "one", "One two", "one  TWO\tthree", "one two three four", "a\x1cb\xa0c\x85d"]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 90))) for _ in range(30)]
    texts += [f"{rng.choice(words)} {passage}\n{passage[:120]} tail {k}" for k in range(6)] + [passage, passage.upper(), passage + " "]
    texts += ["a b " * 40, "word " * 25, "word " * 25, "line of some length\nLINE of some length \nother\nline of some length", "  line of some length", "other\nother\nshort", "éééééééééé\néééééééééé", "éééééééééé", "ééééééééé\nx", "ééééééééé"]
    texts.append(" ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(20000)))
    near = [f"w{k}" for k in range(300)]
    for k in range(8):
        near[rng.randrange(300)] = f"new{k}"
        texts.append(" ".join(near))
    rows = [(3 * k, t) for k, t in enumerate(texts)]
    return rows + [(7, texts[20]), (7, texts[21]), (9, texts[45]), (9, texts[45])]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", 1, 2, "clash", "clash") for d, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    real = [(r.doc_id + 10_000, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    return awkward() + real


def as_set(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_simhash(spark, rows):
    def fingerprint(text):
        w = WORD.findall(lower(text or ""))
        shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [(d, fingerprint(t)) for d, t in rows]
    distinct = sorted({f for _, f in prints})
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for d, f in prints:
        least[find(f)] = min(d, least.get(find(f), d))
    got = simhash.near_duplicates(frame(spark, rows)).select("doc_id", queries.hex64("fingerprint").alias("f"), "component_id")
    assert as_set(got, "doc_id", "f", "component_id") == sorted((d, f"{f:016x}", least[find(f)]) for d, f in prints)


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_bit_sliced_links_equal_brute_force(spark, radius, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 40)  # the fine tables are used as well
    rng = random.Random(radius)
    values = {rng.getrandbits(64) for _ in range(50)} | {0, 2**64 - 1}
    for centre in list(values)[:5]:
        values |= {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(120)}
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    got = {frozenset(x % 2**64 for x in (r.a, r.b)) for r in simhash.links(df, radius).collect()}
    v = sorted(values)
    assert got == {frozenset((a, b)) for i, a in enumerate(v) for b in v[i + 1 :] if (a ^ b).bit_count() <= radius}


def test_similar_groups(spark, rows):
    """Pairs well over the threshold are together, groups are made of pairs not far under it."""

    def shingles(text):
        w = WORD.findall(lower(text or ""))
        return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)])

    got = simhash.similar(frame(spark, rows)).collect()
    group = {r.doc_id: r.component_id for r in got}
    repeated = {d for d, n in Counter(d for d, _ in rows).items() if n > 1}
    sets = [(d, shingles(t)) for d, t in rows]
    near = set()
    for i, (a, s) in enumerate(sets):
        for b, t in sets[i + 1 :]:
            j = len(s & t) / len(s | t)
            if j >= 0.87 and not {a, b} & repeated:
                assert group[a] == group[b], (a, b, j)
            if j >= 0.65:
                near |= {a, b}
    for d in group.keys() - repeated:  # whoever is in a group has a partner that is near
        assert group[d] == d or d in near, d


def test_similar_links_are_exact_with_repeated_passages_and_at_the_threshold(spark):
    """Passages repeated many times in one text, and pairs on both sides of 0.8, are grouped as brute force groups them."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**9)}"
    texts = []
    for _ in range(40):  # the sets of a pair differ in the few shingles where repeats meet
        common, passage = [word() for _ in range(300)], [word() for _ in range(60)]
        texts += [" ".join(common + passage), " ".join(common + passage * 20)]
    for tail in [*range(20, 30), *range(60, 80)] * 3:  # Jaccard (296 - tail) / (296 + tail): from 0.87 down to 0.83, then 0.66 to 0.58
        common, a, b = [word() for _ in range(300 - tail)], [word() for _ in range(tail)], [word() for _ in range(tail)]
        texts += [" ".join(common + a), " ".join(common + b)]
    for tail in range(29, 39):  # 0.82 to 0.77
        for _ in range(3):
            common, a, b = [word() for _ in range(300 - tail)], [word() for _ in range(tail)], [word() for _ in range(tail)]
            texts += [" ".join(common + a), " ".join(common + b)]
    chain = [word() for _ in range(300)]
    for k in range(12):  # neighbours at 0.85, the ends far apart
        texts.append(" ".join(chain))
        chain[24 * k : 24 * k + 24] = [word() for _ in range(24)]
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for w in (t.split() for t in texts)]
    label = list(range(len(texts)))
    for i, s in enumerate(sets):
        for j in range(i):
            if len(s & sets[j]) / len(s | sets[j]) >= 0.8 and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    assert {label[2 * k + 1] == 2 * k for k in range(40)} == {True}
    got = {r.doc_id: r.component_id for r in simhash.similar(frame(spark, list(enumerate(texts)))).collect()}
    assert got == dict(enumerate(label))


def test_line_dedup(spark, rows):
    holders, lines = defaultdict(set), []
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    for d, t in rows:
        parts = (t or "").split("\n")
        lines.append((d, parts))
        for line in parts:
            if len(key(line)) >= 10:
                holders[key(line)].add(d)
    want = []
    for d, parts in lines:
        kept = [x for x in parts if len(holders[key(x)]) < 2 or min(holders[key(x)]) == d]
        want.append((d, len(parts), len(parts) - len(kept), sha("\n".join(kept))))
    docs = frame(spark, rows)
    bitmaps = linededup.keep_bitmaps(docs)
    assert "_text" not in bitmaps.columns and bitmaps.count() == len(set(rows))
    got = linededup.apply_bitmaps(docs, bitmaps)
    assert sorted((r.row.doc_id, r.n_lines, r.n_dropped, sha(r.kept or "")) for r in got.collect()) == sorted(want)
    assert {r.row.doc_id for r in got.collect() if r.kept is None} == {d for d, t in rows if t is None}
    for r in got.collect():
        assert linededup.unpacked(r.bitmap, r.n_lines).sum() == r.n_lines - r.n_dropped


@pytest.mark.parametrize("hot", [substring.HOT, 1])
def test_substring_dedup(spark, rows, hot, monkeypatch):
    monkeypatch.setattr(substring, "HOT", hot)
    first, docs = {}, []
    tag = {(r._id, r._text): r._tag for r in __import__("tidemark.llm.common", fromlist=["keyed"]).keyed(frame(spark, rows), "doc_id", "text").collect()}
    for d, t in rows:
        w = WORD.findall(t or "")
        docs.append((d, tag[d, t or ""], w))
        for k in range(len(w) - 19):
            at = (d, tag[d, t or ""], k)
            s = tuple(w[k : k + 20])
            first[s] = min(at, first.get(s, at))
    want = []
    for d, g, w in docs:
        gone = set()
        for k in range(len(w) - 19):
            if first[tuple(w[k : k + 20])] != (d, g, k):
                gone |= set(range(k, k + 20))
        want.append((d, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    got = substring.drop_repeated_passages(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, sha(r.kept)) for r in got) == sorted(want)


def test_substring_spans_are_maximal_and_disjoint(spark, rows):
    for r in substring.drop_repeated_passages(frame(spark, rows)).collect():
        assert all(a.stop < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))
        assert sum(s.stop - s.start for s in r.spans) == r.n_removed


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, rows, weak):
    from pyspark.sql import functions as F

    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for d, t in rows:
        groups[norm(t)].append(d)
    want = sorted((d, min(groups[norm(t)]), len(groups[norm(t)]), d == min(groups[norm(t)])) for d, t in rows)
    kind = {"digest": lambda c: F.length(c)} if weak else {}
    got = exact.exact_groups(frame(spark, rows), **kind)
    assert as_set(got, "doc_id", "keep_id", "group_size", "kept") == want


def test_bpe_equals_the_library(spark, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    want = []
    for d, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    docs = frame(spark, rows)
    assert as_set(bpe.round_trip(docs, queries.tokenizer_path()), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want)
    back = bpe.decoded(bpe.encoded(docs, queries.tokenizer_path()), queries.tokenizer_path())
    assert as_set(back, "doc_id", "text") == sorted((d, text or "") for d, text in rows)


def test_bpe_long_fragments_and_odd_texts():
    from tokenizers import Tokenizer

    t, c = Tokenizer.from_file(queries.tokenizer_path()), bpe.codec(queries.tokenizer_path())
    rng = random.Random(1)
    texts = ["x" * 3000, "ab" * 1000, "\x1c\x1d a\x85b\u3000d", "日本語 １２３ ½ ²", "a<|endoftext|>b <|endoftext|>", "..." * 200 + " " * 700]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x250), rng.randrange(0x300, 0x3000), 10, 32])) for _ in range(80)) for _ in range(200)]
    for text, raw in zip(texts, c.encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_token_files(spark, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    some = sorted(set(rows), key=lambda r: (r[0], r[1] or ""))
    some = [r for k, r in enumerate(some) if k == 0 or some[k - 1][0] != r[0]]
    at, want = 0, []
    for d, text in some:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    out = new_path(spark, "tokens")
    tokenstore.write_tokens(frame(spark, some), out, queries.tokenizer_path(), 2)
    files = tokenstore.read_tokens(spark, out)
    assert as_set(tokenstore.with_starts(tokenstore.checksums(files), files), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want)
    plan = files.where("doc_id = 30").select("n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,30)" in plan and "ids" not in plan.split("ReadSchema")[1]


def test_contaminations(spark):
    rng = random.Random(3)
    letters = "etaoinshrdlu"
    prose = lambda n: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(n))
    items = [(k, prose(40)) for k in range(6)] + [(6, "tiny"), (7, None), (8, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    typo = list(items[3][1])
    for k in range(10, len(typo), 25):
        typo[k] = "z"
    rows = [(0, prose(300)), (1, prose(100) + " " + items[0][1].upper() + " " + prose(50)), (2, "\n".join(items[1][1].split())), (3, prose(30) + " " + "".join(typo)), (4, items[2][1][: len(items[2][1]) * 3 // 4] + prose(90)), (5, None), (6, ""), (7, prose(10) + " tiny"), (8, prose(2000))]
    got = decontam.contaminations(frame(spark, rows), bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(1, 0), (2, 1), (3, 3), (4, 2), (7, 6)}
    kept = decontam.drop_contaminated(frame(spark, rows), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 5, 6, 8] and kept.columns == frame(spark, rows).columns


def test_alignment_equals_the_full_table():
    rng = random.Random(4)
    for _ in range(60):
        p = np.array([rng.randrange(3) for _ in range(12)], np.uint32)
        t = np.array([rng.randrange(3) for _ in range(30)], np.uint32)
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p):
            new = [i + 1]
            for j, x in enumerate(t):
                new.append(min(row[j] + (x != c), row[j + 1] + 1, new[j] + 1))
            row = new
        got, _ = decontam.banded_distances([p], t, np.array([0]), np.array([len(t)]), np.array([-len(p)]), np.array([len(p) + len(t) + 1]))
        assert got[0] == min(row)


def test_language_id(spark, sf_dir):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    made = langid.predictions(docs, langid.fit(docs, ~queries.held_out())).join(docs.select("doc_id", "lang"), "doc_id").where(queries.held_out())
    right, n, lost = made.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.avg(F.col("rejected").cast("int"))).first()
    assert n > 150 and right > 0.97 and lost < 0.03


def test_language_id_of_awkward_texts(spark, rows):
    model = langid.train(["the cat and the dog", "le chat et le chien"] * 10, ["en", "fr"] * 10)
    got = {(r.doc_id, r.lang_pred) for r in langid.predictions(frame(spark, rows), model).collect()}
    assert {(0, "und"), (3, "und"), (6, "und")} <= got and all(x in ("en", "fr", "und") for _, x in got)
    empty = langid.fit(frame(spark, [(1, None)]))
    assert [r.lang_pred for r in langid.predictions(frame(spark, [(1, "abc"), (2, None)]), empty).collect()] == ["und"] * 2


URLS = [None, "", "no scheme", "http://A.Example.ORG/es/x?q#f", "https://example.org/en/123", "https://example.org/en/2", "http://x.com/fr/", "http://x.com/de/a", "http://com/de/", "ftp://org", "http://org/", "http://notexample.org/es/1", "http://example.org:80/es/", "x://y://z.com/de/1", "http://b.com?x=://a.com/de/", "http://../de/", "http:///de/", "http://x.com/de\n/", "a\nb://x.com/de/"]


def test_url_filter(spark):
    def brute(url):
        host, path = "", ""
        if url is not None and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = lower(host)
        fits = [(len(h + p), len(h), h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        return host, path, best and best[2], best[3] if best else "allow"

    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").selectExpr("*", "'clash' as host", "1 as verdict")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judged(df, queries.URL_RULES).collect()}
    assert got == {k: brute(u) for k, u in enumerate(URLS)}


def test_url_digest_collisions_are_confirmed(tmp_path, monkeypatch):
    monkeypatch.setattr(urlfilter, "_digest", lambda host, path: len(host) % 2)
    urlfilter.write_rules([("block", "aa.com", "/"), ("allow", "bb.com", "/"), ("block", "c.com", "/x")], str(tmp_path / "r"))
    rules = urlfilter.RuleFile(str(tmp_path / "r"))
    assert rules.judge(["aa.com", "x.bb.com", "cc.com", "c.com"], ["/1", "/", "/", "/xy"]) == (["aa.com/", "bb.com/", None, "c.com/x"], ["block", "allow", None, "block"])


def test_chat(spark):
    schema = {"add": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 0}}, "additionalProperties": False}}
    m = [
        (1, 0, "system", "hé", None, None, None, None, None),
        (1, 1, "assistant", None, "c1", "add", '{"b": 1, "a": -1}', None, None),
        (1, 2, "assistant", None, "c2", "add", '{"a": 2}', None, ["c3"]),
        (1, 3, "assistant", None, "c3", "add", "{", None, None),
        (1, 4, "tool", "3", None, None, None, "c3", None),
        (1, 5, "tool", "1", None, None, None, "c1", None),
        (1, 6, "tool", "2", None, None, None, "c2", None),
        (1, 7, "tool", "again", None, None, None, "c2", None),
        (1, 8, "tool", "?", None, None, None, "nowhere", None),
        (1, 9, "assistant", None, "c1", "add", '{"a": 1}', None, None),
        (1, 10, "assistant", None, "c4", "other", None, None, ["c4"]),
        (2, 0, None, None, "c1", "add", '{"a": true}', None, None),
        (None, None, "user", "x", None, None, None, None, None),
    ]
    df = spark.createDataFrame(m, "conv long, turn long, role string, text string, call_id string, tool string, arguments string, answers string, after array<string>")
    got = {(r.conv, r.turn): r for r in chat.linked(df, schema).collect()}
    status = {k: r.status for k, r in got.items()}
    assert [status[1, k] for k in range(11)] == ["plain", "linked", "linked", "linked", "linked", "linked", "linked", "repeated", "orphan", "repeated", "cyclic"]
    assert status[2, 0] == "open" and status[None, None] == "plain"
    assert got[1, 1].message == '{"content":null,"role":"assistant","tool_calls":[{"arguments":{"a":-1,"b":1},"id":"c1","name":"add"}]}'
    assert got[1, 0].message == '{"content":"hé","role":"system"}'
    assert list(got[1, 1].problems) == ["$.a: under the minimum", "$.b: unknown"] and list(got[1, 3].problems) == ["$: not JSON"] and list(got[1, 10].problems) == ["unknown tool"]
    order = [k for _, k in sorted((((r.root_turn, r.level, r.turn), k[1]) for k, r in got.items() if k[0] == 1))]
    assert order.index(3) < order.index(4) < order.index(2) < order.index(6) and order.index(1) < order.index(5)


def test_chat_orders_chains_of_any_length(spark):
    """A chain of 40 calls told backwards is ordered; a cycle, and what comes after it, is not."""
    call = lambda turn, name, after: (1, turn, "assistant", None, name, "t", "{}", None, after)
    rows = [call(39 - k, f"c{k}", [f"c{k - 1}"] if k else None) for k in range(40)]
    rows += [call(100, "x", ["y"]), call(101, "y", ["x"]), call(102, "z", ["x", "c3"]), call(103, "w", ["c39", "c1", "gone"])]
    rows += [(1, 200 + k, "tool", "r", None, None, None, r[4], None) for k, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "conv long, turn int, role string, text string, call_id string, tool string, arguments string, answers string, after array<string>")
    got = {r.call_id: r for r in chat.linked(df, {"t": {}}).collect() if r.call_id}
    assert [(got[f"c{k}"].status, got[f"c{k}"].level, got[f"c{k}"].root_turn) for k in range(40)] == [("linked", 2 * k, 39) for k in range(40)]
    assert {got[c].status for c in "xyz"} == {"cyclic"} and (got["w"].status, got["w"].level, got["w"].root_turn) == ("linked", 80, 103)


EMPTY = {
    "simhash": lambda df, s: simhash.near_duplicates(df),
    "similar": lambda df, s: simhash.similar(df),
    "bpe": lambda df, s: bpe.round_trip(df, queries.tokenizer_path()),
    "lines": lambda df, s: linededup.apply_bitmaps(df, linededup.keep_bitmaps(df)).select("row.doc_id"),
    "substring": lambda df, s: substring.drop_repeated_passages(df),
    "exact": lambda df, s: exact.exact_groups(df),
    "decontam": lambda df, s: decontam.contaminations(df, s.createDataFrame([], "item_id long, text string")),
    "langid": lambda df, s: langid.predictions(df, langid.fit(df)),
}


@pytest.mark.parametrize("name", EMPTY)
def test_empty_tables_and_null_ids(spark, name):
    assert EMPTY[name](frame(spark, []), spark).collect() == []
    nulls = frame(spark, [(None, None), (None, "a line of text that is long"), (1, "a line of text that is long"), (None, "a line of text that is long")])
    got = EMPTY[name](nulls, spark)
    n = 0 if name == "decontam" else 4
    assert got.count() == n and (not n or sum(r.doc_id is None for r in got.collect()) == 3)


def test_empty_token_files(spark):
    out = new_path(spark, "tokens")
    tokenstore.write_tokens(frame(spark, []), out, queries.tokenizer_path(), 2)
    files = tokenstore.read_tokens(spark, out)
    assert tokenstore.with_starts(tokenstore.checksums(files), files).collect() == []


def test_short_items_are_found_as_they_are(spark):
    bench = spark.createDataFrame([(1, "What is 2+2? 4"), (None, "Ok  then"), (-1, "ok then!"), (3, " \n")], "item_id long, text string")
    texts = ["so: what is 2+2?  4", "what is 2+2? 40", "it was ok\nthen.", "book then", "ok then!", "xok then! y"]
    got = decontam.contaminations(frame(spark, list(enumerate(texts))), bench).collect()
    assert {(r.doc_id, r.item_id, r.edits, r.start, r.stop) for r in got} == {(0, 1, 0, 4, 18), (2, None, 0, 7, 14), (4, None, 0, 0, 7), (4, -1, 0, 0, 8)}
    kept = decontam.drop_contaminated(frame(spark, list(enumerate(texts))), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5]


def _brute_contaminations(docs, items):
    """Each item's segments against whole documents by a plain alignment; the pairs within the edits."""
    met = set()
    for item, text in items:
        whole = decontam.normal(text or "")
        if not whole:
            continue
        last = max(0, len(whole) - decontam.SEGMENT)
        for at in {*range(0, last, decontam.SEGMENT // 2), last}:
            p = np.frombuffer(whole[at : at + decontam.SEGMENT].encode("utf-32-le"), np.uint32)
            for d, t in docs:
                if (d, item) in met:
                    continue
                c = np.frombuffer(decontam.normal(t or "").encode("utf-32-le"), np.uint32)
                cost, ramp = np.zeros(len(c) + 1, np.int64), np.arange(len(c) + 1)
                for i, x in enumerate(p):
                    new = np.concatenate([[i + 1], np.minimum(cost[:-1] + (c != x), cost[1:] + 1)])
                    cost = np.minimum.accumulate(new - ramp) + ramp
                if cost.min() <= int(decontam.RATE * len(p)):
                    met.add((d, item))
    return met


def test_contaminations_equal_full_alignment(spark):
    """Regions with 0 to 12 edits in a segment's length, in plain texts and over the edge of a piece of a long one."""
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    items = [(k, prose(22)) for k in range(4)]
    docs = []
    for k in range(40):
        copy = list(items[k % 4][1])
        for at in rng.sample(range(len(copy)), k * 12 // 40):
            copy[at] = rng.choice(["", "q", copy[at] + "j"])
        docs.append((k, prose(15) + " " + "".join(copy) + " " + prose(15)))
    want = _brute_contaminations(docs, items)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminations(frame(spark, docs), bench).collect()}
    assert got <= want and len(want) > 20
    missed = want - got
    assert not missed, missed


def test_long_texts_are_searched_in_pieces(spark, monkeypatch):
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    item = prose(20)
    index = decontam.build_index([(1, item), (2, "short one")])
    texts = [prose(rng.randrange(1, 400)) + "  " + item + " \n " + prose(300) + " short one " + prose(700) for _ in range(30)]
    want = sorted(decontam._found(index, texts, decontam.Q))
    monkeypatch.setattr(decontam, "CHUNK", 1000)
    monkeypatch.setattr(decontam, "OVERLAP", 600)
    chunks = decontam._chunks.__defaults__
    monkeypatch.setattr(decontam._chunks, "__defaults__", (1000,))
    for text in [*texts, "x" * 5000, " " * 3000, "a " * 2000]:
        whole = decontam.normal(text)
        assert all(whole[at : at + len(piece)] == piece for at, piece in decontam._chunks(text)) and chunks
        assert max((at + len(p) for at, p in decontam._chunks(text)), default=0) == len(whole)
    assert sorted(decontam._found(index, texts, decontam.Q)) == want and len(want) == 60


def test_several_blocks_of_the_benchmark(spark, sf_dir, monkeypatch):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    key = lambda rows: {(r.doc_id, r.item_id, r.edits) for r in rows}
    want = key(decontam.contaminations(docs, bench).collect())
    kept = {r.doc_id for r in decontam.drop_contaminated(docs, bench).collect()}
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 4000)
    assert {x[:2] for x in key(decontam.contaminations(docs, bench).collect())} == {x[:2] for x in want}
    assert {r.doc_id for r in decontam.drop_contaminated(docs, bench).collect()} == kept


def test_language_id_learns_from_long_texts_alone(spark):
    en, fr = "the cat and the dog went over the hill ", "le chat et le chien sont dans la maison "
    docs = [(k, (en if k % 2 else fr) * 700) for k in range(20)]
    df = spark.createDataFrame([(d, t, "en" if d % 2 else "fr") for d, t in docs], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.predictions(df, langid.fit(df)).collect()}
    assert got == {d: "en" if d % 2 else "fr" for d, _ in docs}


def test_language_sample_is_bounded_and_takes_every_language(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 60)
    rows = [(k, f"text number {k % 700}", f"l{k % 30}") for k in range(2000)] + [(1, "the same row", "l0")] * 500 + [(9, "rare", "rarest"), (10, None, "never")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts, labels = langid.sample(df)
    assert len(texts) <= 60 and set(labels) == {f"l{k}" for k in range(30)} | {"rarest"}
    assert (texts, labels) == langid.sample(df.repartition(5))


def test_language_of_pieces_is_that_of_the_whole(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcé  .\n日") for _ in range(rng.randrange(0, 400))) for _ in range(40)] + ["", "x" * 300]
    model = langid.train(["the cat and the dog", "le chat et le chien"] * 10, ["en", "fr"] * 10)
    z, letters = model.logits(texts)
    monkeypatch.setattr(langid._pieces, "__defaults__", (50,))
    z2, letters2 = model.logits(texts)
    assert np.allclose(z, z2) and (letters == letters2).all()


def test_token_file_starts_with_several_files_a_task(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = new_path(spark, "tokens")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 40)
    try:
        tokenstore.write_tokens(docs, out, queries.tokenizer_path(), 2)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    files = tokenstore.read_tokens(spark, out)
    rows = sorted(tokenstore.with_starts(tokenstore.checksums(files), files).collect(), key=lambda r: r.doc_id)
    assert len({r.file for r in rows}) > 4
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]


def test_url_rule_hosts_are_lower_cased_as_urls_are(tmp_path):
    urlfilter.write_rules([("block", "É.Com", "/")], str(tmp_path / "r"))
    assert urlfilter.RuleFile(str(tmp_path / "r")).judge(["É.com", "é.com"], ["/", "/"])[1] == ["block", None]


def test_url_filter_of_empty_tables_and_null_ids(spark):
    schema = "page_id long, url string"
    assert urlfilter.judged(spark.createDataFrame([], schema), queries.URL_RULES).collect() == []
    assert [r.page_id for r in urlfilter.judged(spark.createDataFrame([(None, "http://a.com/de/")] * 2, schema), queries.URL_RULES).collect()] == [None, None]


CHAT = "conv long, turn int, role string, text string, call_id string, tool string, arguments string, answers string, after array<string>, level string, status int, _conv string"


def test_chat_of_null_conversations_and_empty_tables(spark):
    assert chat.linked(spark.createDataFrame([], CHAT), {}).collect() == []
    rows = [(None, 1, "assistant", None, "c", "t", "{}", None, None, "x", 1, "y"), (None, 2, "tool", "r", None, None, None, "c", None, "x", 1, "y"), (0, 3, "tool", "r", None, None, None, "c", None, "x", 1, "y"), (1, None, "assistant", None, "d", "t", "{}", None, ["e"], "x", 1, "y")]
    got = chat.linked(spark.createDataFrame(rows, CHAT), {"t": {}}).collect()
    assert sorted((str(r.conv), str(r.turn), r.status, str(r.root_turn), r.level) for r in got) == sorted([("None", "1", "linked", "1", 0), ("None", "2", "linked", "1", 1), ("0", "3", "orphan", "3", 0), ("1", "None", "open", "None", 0)])


def test_chat_levels_equal_brute_force(spark):
    """Random graphs of calls, with chains, joins and cycles, in three conversations."""
    rng = random.Random(4)
    rows, after, turn = [], {}, {}
    for conv in range(3):
        for k in range(120):
            far = [f"c{j}" for j in (rng.randrange(120) if rng.random() < 0.02 else rng.randrange(k + 1), max(0, k - 1)) if j != k or rng.random() < 0.02]
            after[conv, f"c{k}"] = rng.choice([None, far[-1:], far[-1:], far[:1], far]) if k % 40 else None
            if conv == 0 and 10 <= k <= 13:  # a cycle of three, and a call after it
                after[conv, f"c{k}"] = [{10: "c12", 11: "c10", 12: "c11", 13: "c11"}[k]]
            if conv == 1 and 60 <= k < 110:  # a long chain that waits for one call each
                after[conv, f"c{k}"] = [f"c{k - 1}"]
            turn[conv, f"c{k}"] = rng.randrange(1000)
            rows.append((conv, turn[conv, f"c{k}"], "assistant", None, f"c{k}", "t", "{}", None, after[conv, f"c{k}"], None, None, None))
    level, root = {}, {}
    for _ in range(400):
        for key, before in after.items():
            ahead = [(key[0], b) for b in set(before or ())]
            if all(a in level for a in ahead):
                level[key] = 1 + max((level[a] for a in ahead), default=-1)
                root[key] = max([turn[key], *(root[a] for a in ahead)])
    got = chat.linked(spark.createDataFrame(rows, CHAT), {"t": {}}).collect()
    assert 0 < len(level) < len(after) and max(level.values()) > 32
    for r in got:
        key = r.conv, r.call_id
        assert (r.status, r.level, r.root_turn) == (("open", 2 * level[key], root[key]) if key in level else ("cyclic", 0, r.turn)), key


def test_hashes_of_long_texts_in_pieces():
    text = ("Ab cd  e\tf " * 40 + "x" * 500 + " y" * 90).encode()
    whole = np.concatenate(list(simhash._shingles(text, 5)))
    for size in (7, 64, 1000):
        assert (np.concatenate(list(simhash._shingles(text, 5, size))) == whole).all()
    assert list(map(len, simhash._shingles(b"a b c " + b" " * 99, 5, 10))) == [1] and list(simhash._shingles(b"  ", 5)) == []


def test_similar_groups_in_several_blocks(spark, monkeypatch):
    """Groups over the block size: dense copies, and texts that only a chain joins."""
    monkeypatch.setattr(simhash, "TEXTS", 5)
    monkeypatch.setattr(simhash, "SPLIT", 6)
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**9)}"
    texts = []
    for _ in range(3):
        base = [word() for _ in range(200)]
        for k in range(30):
            copy = list(base)
            for at in rng.sample(range(200), k // 5):
                copy[at] = word()
            texts.append(" ".join(copy))
    chain = [word() for _ in range(300)]
    for k in range(12):
        texts.append(" ".join(chain))
        chain[24 * k : 24 * k + 24] = [word() for _ in range(24)]
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for w in (t.split() for t in texts)]
    label = list(range(len(texts)))
    for i, s in enumerate(sets):
        for j in range(i):
            if len(s & sets[j]) / len(s | sets[j]) >= 0.8 and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    got = {r.doc_id: r.component_id for r in simhash.similar(frame(spark, list(enumerate(texts)))).collect()}
    assert got == dict(enumerate(label)) and len(set(label)) < len(label) / 3


def test_looked_up(spark):
    from tidemark.llm.common import looked_up

    rows = spark.createDataFrame([(1, k) for k in range(200)] + [(2, 0), (2, 0), (3, 1)], "k int, v int")
    table = spark.createDataFrame([(1, "a"), (2, "b"), (4, "c")], "k int, x string")
    got = sorted((r.k, r.v, r.x) for r in looked_up(rows, ["k"], table).collect())
    assert got == sorted([(1, k, "a") for k in range(200)] + [(2, 0, "b")] * 2)


def test_language_scores_equal_plain_sums():
    """Each text's logits from its character n-grams one by one."""
    mask, base = 2**64 - 1, 0x9E3779B97F4A7C15
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcé  .\n日İ") for _ in range(rng.randrange(0, 60))) for _ in range(30)]
    model = langid.train(["the cat and the dog", "le chat et le chien"] * 10, ["en", "fr"] * 10)

    def mix(x):
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & mask
        return x ^ x >> 31

    for text, z, letters in zip(texts, *model.logits(texts), strict=True):
        words = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text).split()
        grams = []
        for w in words:
            padded = f" {w} "
            for n in langid.ORDERS:
                for k in range(len(padded) - n + 1):
                    g = padded[k : k + n]
                    if g.strip() and not (n > 2 and g[1] == " "):
                        grams.append(g)
        # a space between two words is the end of the one and the beginning of the other, in a gram of two each
        assert letters == sum(map(len, words))
        total = np.zeros(2)
        for g in grams:
            h = 0
            for c in g:
                h = (h * base + ord(c)) & mask
            total += model.table[mix((h + len(g)) & mask) >> (64 - langid.BUCKET_BITS)]
        assert z == pytest.approx(total / max(1, len(grams)) + model.bias, abs=1e-9), text
