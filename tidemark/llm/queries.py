"""The text operators as queries over the given tables, and DuckDB SQL where it can say the same."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import align, bpe, chat, decontam, exact, langid, linededup, merkle, quality, simhash, substring, tokenstore, urlfilter
from tidemark.llm.common import new_path

TOKENIZER, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
END_ID = 2
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: The tools as which a user's turns are put to the assistant: the first of a conversation, and one that follows others.
_PROMPT = {"type": "string", "minLength": 1}
TOOLS = {
    "ask": {"type": "object", "required": ["prompt"], "properties": {"prompt": _PROMPT}, "additionalProperties": False},
    "follow_up": {"type": "object", "required": ["prompt", "turn"], "properties": {"prompt": _PROMPT, "turn": {"type": "integer", "minimum": 1}}, "additionalProperties": False},
}


def tokenizer_path() -> str:
    """TIDEMARK_TOKENIZER, or the file of the installed public tokenizers."""
    if path := os.environ.get("TIDEMARK_TOKENIZER"):
        return path
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def pieces_path() -> str:
    """TIDEMARK_PIECES, or the file of the installed public tokenizers."""
    if path := os.environ.get("TIDEMARK_PIECES"):
        return path
    import public_tokenizers

    return public_tokenizers.path(PIECES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hex64(column: str) -> F.Column:
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex64("fingerprint").alias("fingerprint"), "component_id")


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = linededup.apply_bitmaps(docs, linededup.keep_bitmaps(docs))
    return kept.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.drop_repeated_passages(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "tokens")
    tokenstore.write_tokens(table(spark, sf_dir, "documents"), out, tokenizer_path(), END_ID)
    rows = tokenstore.read_tokens(spark, out)
    return tokenstore.with_starts(tokenstore.checksums(rows), rows).select("doc_id", "start", "n_tokens", "ids_crc32")


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn is a call, which uses the results of the calls in the two turns before; the assistant turn next to it answers that call."""
    t = table(spark, sf_dir, "conversations")
    name = lambda turn: F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string"))
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    follows = F.col("turn") >= 2
    arguments = F.when(follows, F.to_json(F.struct(F.col("text").alias("prompt"), "turn"))).otherwise(F.to_json(F.struct(F.col("text").alias("prompt"))))
    messages = t.select(
        F.col("conv_id").alias("conv"), "turn", "role", F.when(~F.coalesce(user, F.lit(False)), F.col("text")).alias("text"),
        F.when(user, name(F.col("turn"))).alias("call_id"), F.when(user, F.when(follows, "follow_up").otherwise("ask")).alias("tool"),
        F.when(user, arguments).alias("arguments"), F.when(assistant, name(F.col("turn") - 1)).alias("answers"),
        F.when(user & follows, F.array(name(F.col("turn") - 1), name(F.col("turn") - 2))).alias("after"),
    )
    rows = chat.linked(messages, TOOLS)
    return rows.select(F.col("conv").alias("conv_id"), "turn", "role", "status", "root_turn", "level", F.array_join("problems", "; ").alias("problems"), "message")


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, ~held_out())
    return langid.predictions(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judged(table(spark, sf_dir, "pages"), URL_RULES)


def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    leaves = merkle.leaves(docs, ["doc_id", "source", "lang", "n_chars", "text"], {"text": merkle.lowered(F.col("text"))}, tampered)
    rows = merkle.manifest(leaves).rows
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = F.crc32(F.col("doc_id").cast("string")) % 3
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), remainder != 1)
    return quality.scored(docs, model).select("doc_id", F.coalesce(remainder == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = align.alignments(table(spark, sf_dir, "documents"), tokenizer_path(), pieces_path(), digest=True)
    return rows.withColumnRenamed("groups", "groups_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {
        "op1_simhash_near_dedup": simhash_near_dedup,
        "op2_bpe_round_trip": bpe_round_trip,
        "op3_line_dedup": line_dedup,
        "op4_substring_dedup": substring_dedup,
        "op5_exact_dedup": exact_dedup,
        "op6_token_files": token_files,
        "op7_chat_messages": chat_messages,
        "op8_decontamination": decontamination,
        "op9_language_id": language_id,
        "op10_url_filter": url_filter,
        "op11_merkle_manifest": merkle_manifest,
        "op12_quality_classifier": quality_scores,
        "op13_tokenizer_alignment": tokenizer_alignment,
        "pipeline": corpus_pipeline.run,
    }


def _merkle_sql(levels: int = 6, upper_levels: int = 5) -> str:
    """Trees level by level; 16 ** levels leaves a source and 16 ** upper_levels sources at most."""
    crc = "list_reduce(range(8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384), xor({c}, ascii({x})))"
    crc = f"xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint), lambda a, x: {crc.replace('ascii({x})', 'x').format(c='a')}, 4294967295), 4294967295)"
    leaf = "sha256(" + " || ".join(f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    sql = [
        f"""l as (select doc_id, source, {leaf.format(text="text")} as leaf, {leaf.format(text=lower)} as lowered, {crc} % 5 = 0 as tampered from documents),
        d0 as (select *, case when tampered then lowered else leaf end as folded, '' as proof,
               row_number() over (partition by source order by doc_id nulls last, leaf) - 1 as pos from l),
        t0 as (select source, pos, leaf as d, count(*) over (partition by source) as n from d0)"""
    ]

    def climb(k: int, tree: str) -> None:
        # each level: the runs of 16, where the tree has more than one node; then every document's own way through them
        sql.append(f"""r{k} as (select {tree}, pos // 16 as pos, list(d order by pos) as g, any_value(n) as n from t{k} group by {tree}, pos // 16),
        t{k + 1} as (select {tree}, pos, case when n > 1 then sha256(array_to_string(g, '')) else g[1] end as d, (n + 15) // 16 as n from r{k}),
        d{k + 1} as (select d.* exclude (pos, folded, proof), d.pos // 16 as pos,
               case when n = 1 then folded else sha256(array_to_string(g[1 : (d.pos % 16)::int], '') || folded || array_to_string(g[(d.pos % 16)::int + 2 :], '')) end as folded,
               proof || case when n = 1 then '' else array_to_string(g[1 : (d.pos % 16)::int], '') || array_to_string(g[(d.pos % 16)::int + 2 :], '') end as proof
               from d{k} d join r{k} r on d.{tree} is not distinct from r.{tree} and d.pos // 16 = r.pos)""")

    for k in range(levels):
        climb(k, "source")
    k = levels
    sql.append(f"""s as (select source, d as subroot, row_number() over (order by source nulls first) - 1 as pos, count(*) over () as n from t{k}),
        t{k + 1} as (select 0 as everything, pos, subroot as d, n from s),
        d{k + 1} as (select d.* exclude (pos), 0 as everything, s.pos, s.subroot from d{k} d join s on d.source is not distinct from s.source)""")
    for k in range(levels + 1, levels + 1 + upper_levels):
        climb(k, "everything")
    k = levels + 1 + upper_levels
    return f"""with {", ".join(sql)}
        select doc_id, leaf, subroot, t.d as root, sha256(proof) as proof_sha256, folded as folded_root, folded = t.d as verified from d{k}, t{k} t"""


_SPACE = r"[ \t\n\x0B\f\r]"


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    upper = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    key = upper.format(f"regexp_replace(line, '^{_SPACE}+|{_SPACE}+$', '', 'g')")
    sql = {
        "op3_line_dedup": f"""
            with l as (select doc_id, pos, parts[pos] as line from (select doc_id, parts, unnest(range(1, len(parts) + 1)) as pos
                       from (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents))),
            k as (select doc_id, pos, line, {key} as key from l),
            f as (select key, min(doc_id) as first from k where length(key) >= 10 group by key having count(distinct doc_id) > 1),
            d as (select k.*, f.first is not null and f.first <> k.doc_id as dropped from k left join f using (key))
            select doc_id, count(*) as n_lines, count(*) filter (dropped) as n_dropped,
                   sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not dropped), '')) as kept_sha256
            from d group by doc_id""",
        "op4_substring_dedup": f"""
            with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}+'), lambda x: x <> '') as ws from documents),
            u as (select doc_id, pos, ws[pos] as word from (select doc_id, ws, unnest(range(1, len(ws) + 1)) as pos from w)),
            s as (select doc_id, pos, array_to_string(ws[pos : pos + 19], ' ') as seq from (select doc_id, ws, unnest(range(1, len(ws) - 18)) as pos from w)),
            r as (select doc_id, pos, row_number() over (partition by seq order by doc_id, pos) as n from s),
            g as (select u.doc_id, u.pos, u.word, last_value(r.pos ignore nulls) over (partition by u.doc_id order by u.pos) as hit
                  from u left join r on r.doc_id = u.doc_id and r.pos = u.pos and r.n > 1),
            x as (select *, coalesce(pos - hit < 20, false) as removed from g)
            select w.doc_id, coalesce(any_value(len(w.ws)), 0) as n_words, count(*) filter (x.removed) as n_removed,
                   sha256(coalesce(string_agg(x.word, ' ' order by x.pos) filter (not x.removed), '')) as kept_sha256
            from w left join x using (doc_id) group by w.doc_id""",
        "op5_exact_dedup": f"""
            with n as (select doc_id, regexp_replace(coalesce(text, ''), '{_SPACE}+', ' ', 'g') as t from documents),
            g as (select doc_id, t, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size from n)
            select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256 from g""",
        "op10_url_filter": f"""
            with p as (select page_id, {upper.format("coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '')")} as host,
                       coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') as path from pages),
            rules(verdict, h, s) as (values {", ".join(f"('{v}', '{h}', '{s}')" for v, h, s in URL_RULES)}),
            m as (select page_id, h || s as rule, rules.verdict, row_number() over (partition by page_id order by length(h || s) desc, length(h) desc) as n
                  from p join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, s))
            select p.page_id, host, path, m.rule, coalesce(m.verdict, 'allow') as verdict from p left join m on m.page_id = p.page_id and n = 1""",
    }
    sql["op11_merkle_manifest"] = _merkle_sql()
    return sql | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
