"""Queries that match, compare and classify records, and the scalar functions for text and time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import functions as fn
from tidemark import quality
from tidemark.operators import identity, reshape, snapshots
from tidemark.plans.base import GAMES_SQL, games, load, query, with_


@query("pair_match", with_(GAMES_SQL, """g as (select day, least(home, away) || '|' || greatest(home, away) as pair, count(*) as n, min(game) as game from games group by 1, 2),
    r as (select game as row_id, case when game % 5 = 0 then day + 1 else day end as day, least(home, away) || '|' || greatest(home, away) as pair from games)
    select row_id, coalesce(n, 0) as n_matches, case when n = 1 then g.game end as game, case when n is null then 'UNMATCHED' when n = 1 then 'MATCHED' else 'AMBIGUOUS' end as match_status from r left join g using (day, pair)"""))
def pair_match(spark: SparkSession, sf: str) -> DataFrame:
    g = games(spark, sf)
    rows = g.select(F.col("game").alias("row_id"), F.when(F.col("game") % 5 == 0, F.date_add("day", 1)).otherwise(F.col("day")).alias("day"), F.col("away").alias("team"), F.col("home").alias("opponent"))
    return identity.matched_pairs(rows, g, ["day"], ("team", "opponent"), ("home", "away"), "game", "row_id").select("row_id", "n_matches", "game", "match_status")


@query("unmatched_diagnosis", with_(GAMES_SQL, """r as (select game as row_id, case when game % 5 = 0 then day + 1 else day end as day, home as team, case when game % 3 = 0 then 'e99' else away end as opponent, case when game % 2 = 0 then 'H' else 'A' end as loc from games),
    a as (select day, home, away, min(game) as g from games group by 1, 2, 3), b as (select day, home, min(game) as g from games group by 1, 2), c as (select home, away, min(game) as g from games group by 1, 2)
    select row_id, case when a.g is not null then 'LOCATION_MISMATCH' when b.g is not null then 'OPPONENT_MISMATCH' when c.g is not null then 'DATE_MISMATCH' else 'NONE' end as diagnosis, coalesce(a.g, b.g, c.g) as possible_game
    from r left join a on a.day = r.day and a.home = r.team and a.away = r.opponent left join b on b.day = r.day and b.home = r.team left join c on c.home = r.team and c.away = r.opponent"""))
def unmatched_diagnosis(spark: SparkSession, sf: str) -> DataFrame:
    g = games(spark, sf)
    rows = g.selectExpr("game as row_id", "case when game % 5 = 0 then date_add(day, 1) else day end as day", "home as team", "case when game % 3 = 0 then 'e99' else away end as opponent", "case when game % 2 = 0 then 'H' else 'A' end as location")
    ref = g.selectExpr("game", "day", "home as team", "away as opponent")
    return identity.diagnosed(rows, ref, "day", "team", "opponent", "location", "game").select("row_id", "diagnosis", "possible_game")


@query("crosswalk", """with r as (select c_custkey as id, case when c_custkey % 3 = 0 then null else cast(c_custkey % 700 as varchar) end as k1, case when c_custkey % 7 = 0 then 'x' else cast(c_custkey as varchar) end as k2 from customer),
    t as (select s_suppkey as target, cast(s_suppkey % 90 as varchar) as k1, cast(s_suppkey * 3 as varchar) as k2 from supplier),
    a as (select k1, min(target) as t, count(distinct target) as n from t group by 1), b as (select k2, min(target) as t, count(distinct target) as n from t group by 1)
    select r.id, case when a.n is not null then case when a.n = 1 then a.t end when b.n is not null then case when b.n = 1 then b.t end end as target, case when a.n is not null then 'first' when b.n is not null then 'second' end as method,
           case when a.n is not null then case when a.n = 1 then 'MATCHED' else 'CONFLICT' end when b.n is not null then case when b.n = 1 then 'MATCHED' else 'CONFLICT' end else 'UNMATCHED' end as status
    from r left join a on a.k1 = r.k1 left join b on b.k2 = r.k2""")
def crosswalk(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "customer").selectExpr("c_custkey as id", "case when c_custkey % 3 = 0 then null else cast(c_custkey % 700 as string) end as a1", "case when c_custkey % 7 = 0 then 'x' else cast(c_custkey as string) end as a2")
    ref = load(spark, sf, "supplier").selectExpr("s_suppkey as target", "cast(s_suppkey % 90 as string) as b1", "cast(s_suppkey * 3 as string) as b2")
    return identity.crosswalk(rows, ref, "id", "target", [("first", "a1", "b1"), ("second", "a2", "b2")])


_SNAP = """s as (select c_custkey as id, c_mktsegment as seg, cast(cast(floor(c_acctbal) as bigint) as varchar) as bal from customer where c_custkey % 10 <> 0),
    n as (select c_custkey as id, case when c_custkey % 6 = 0 then null when c_custkey % 4 = 0 then 'NEW' else c_mktsegment end as seg, cast(cast(floor(c_acctbal) as bigint) as varchar) as bal from customer where c_custkey % 15 <> 1)"""


@query("snapshot_changes", with_(_SNAP, """j as (select coalesce(s.id, n.id) as id, s.id is null as new, n.id is null as gone, s.seg as os, n.seg as ns from s full join n using (id))
    select id, case when new or gone then null else 'seg' end as field, case when new or gone then null else os end as old, case when new or gone then null else ns end as "new", case when new then 'first_seen' when gone then 'dropped' when os is null then 'populated' when ns is null then 'cleared' else 'changed' end as change_type
    from j where new or gone or os is distinct from ns"""))
def snapshot_changes(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "customer").selectExpr("c_custkey as id", "c_mktsegment as seg", "cast(floor(c_acctbal) as bigint) as bal")
    after = c.where("id % 15 <> 1").selectExpr("id", "case when id % 6 = 0 then null when id % 4 = 0 then 'NEW' else seg end as seg", "bal")
    return snapshots.changes(c.where("id % 10 <> 0"), after, "id", ["seg", "bal"])


@query("history_changes", """with d as (select distinct cast(ts as date) as day from events), o as (select day, row_number() over (order by day) as n from d),
    r as (select user_id, cast(ts as date) as day, max_by(event_type, (ts, event_id)) as kind from events group by 1, 2),
    w as (select user_id, day, n, kind, lag(n) over x as b, lead(n) over x as a, lag(kind) over x as old from r join o using (day) window x as (partition by user_id order by n))
    select user_id, cast(day as varchar) as day, case when b = n - 1 then 'kind' end as field, case when b = n - 1 then old end as old, case when b = n - 1 then kind end as "new", case when b = n - 1 then 'changed' else 'first_seen' end as change_type from w where b is distinct from n - 1 or kind <> old
    union all select user_id, cast(o.day as varchar), null, null, null, 'dropped' from w join o on o.n = w.n + 1 where a is null or a > w.n + 1""")
def history_changes(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("kind"))
    return snapshots.history_changes(e, "user_id", "day", ["kind"]).withColumn("day", F.col("day").cast("string"))


@query("observation_union", "select coalesce(a.user_id, b.user_id) as user_id, a.n as pre_n, b.n as post_n, a.n is not null as pre_observed, b.n is not null as post_observed from (select user_id, count(*) as n from events where event_type = 'signup' group by 1) a full join (select user_id, count(*) as n from events where event_type = 'purchase' and value > 20 group by 1) b using (user_id)")
def observation_union(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    n = lambda c: e.where(c).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return snapshots.observations(n("event_type = 'signup'"), n("event_type = 'purchase' and value > 20"), ["user_id"])


@query("attempt_states", """select user_id, case when bool_or(event_type = 'error') then 'rejected' when bool_or(event_type = 'click') then 'failed' when bool_or(event_type = 'purchase') then 'success' else 'eligible' end as state, count(*) as n_attempts from events where value > 30 group by 1""")
def attempt_states(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").where("value > 30").withColumn("outcome", F.when(F.col("event_type") == "error", "rejected").when(F.col("event_type") == "click", "failed").when(F.col("event_type") == "purchase", "success"))
    return fn.attempt_states(e, "user_id", "outcome")


@query("run_reliability", """select user_id % 10 as source, count(*) as n_attempts, count(*) filter (event_type = 'purchase') as n_success, round(median(value), 6) as median_latency, round(quantile_cont(value, 0.95), 6) as p95_latency, count(*) filter (event_type = 'click') as n_click, count(*) filter (event_type = 'view') as n_view from events group by 1""")
def run_reliability(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").withColumns({"source": F.col("user_id") % 10, "outcome": F.when(F.col("event_type") == "purchase", "success")})
    out = snapshots.reliability(e, ["source"], "outcome", "value", ["click", "view"], "event_type")
    return out.withColumns({c: F.round(c, 6) for c in ("median_latency", "p95_latency")})


@query("evidence_states", """with r as (select event_id, case event_id % 7 when 0 then 'Out' when 1 then ' doubtful' when 2 then 'Probable' when 3 then 'IR' end as injury, case event_id % 5 when 0 then 'Full' when 1 then 'LP' when 2 then 'DNP' end as practice, case event_id % 11 when 0 then 'Inactive' else 'Active' end as roster, case event_id % 4 when 0 then '1' when 1 then '2' when 2 then 'x' end as ord from events)
    select event_id, case when roster = 'Inactive' and ord = '1' or injury in ('Out', 'IR') and practice = 'Full' then 'AMBIGUOUS' when injury in ('Out', 'IR') then 'DEPTH_CHART_EXPECTED_OUT' when injury = ' doubtful' then 'DEPTH_CHART_EXPECTED_DOUBTFUL' when injury = 'Probable' then 'DEPTH_CHART_EXPECTED_QUESTIONABLE'
        when practice = 'LP' then 'DEPTH_CHART_EXPECTED_LIMITED' when practice = 'DNP' then 'DEPTH_CHART_EXPECTED_QUESTIONABLE' when ord is null or ord = 'x' then 'UNKNOWN' when ord = '1' then 'DEPTH_CHART_EXPECTED_HEALTHY' else 'BACKUP_CANDIDATE' end as state from r""".replace("case when roster", "case when coalesce(roster").replace("ord = '1' or injury", "ord = '1', false) or coalesce(injury").replace("practice = 'Full' then 'AMB", "practice = 'Full', false) then 'AMB"))
def evidence_states(spark: SparkSession, sf: str) -> DataFrame:
    r = load(spark, sf, "events").selectExpr("event_id", "case event_id % 7 when 0 then 'Out' when 1 then ' doubtful' when 2 then 'Probable' when 3 then 'IR' end as injury", "case event_id % 5 when 0 then 'Full' when 1 then 'LP' when 2 then 'DNP' end as practice", "case event_id % 11 when 0 then 'Inactive' else 'Active' end as roster", "case event_id % 4 when 0 then '1' when 1 then '2' when 2 then 'x' end as ord")
    return r.select("event_id", fn.evidence_state("injury", "practice", "roster", "ord").alias("state"))


@query("freshness_states", """with u as (select user_id, list_sort(list(distinct event_type)) as present, max(ts) as last, bool_or(event_type = 'purchase') as ok, count(*) filter (event_type = 'click') as changes from events group by 1)
    select user_id, case when not ok then 'FETCH_FAILED_USING_NO_FALLBACK' when not list_has_all(present, ['click', 'error']) then 'SCHEMA_DRIFT' when epoch_us(timestamp '2024-01-31') - epoch_us(last) > 86400000000 then 'STALE_LAST_SUCCESS' when changes > 13 then 'FRESH_FETCH_CHANGED' else 'FRESH_FETCH_NO_CHANGE' end as state from u""")
def freshness_states(spark: SparkSession, sf: str) -> DataFrame:
    u = load(spark, sf, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("present"), F.max("ts").alias("last"), F.bool_or(F.col("event_type") == "purchase").alias("ok"), F.greatest(F.count_if(F.col("event_type") == "click") - 13, F.lit(0)).alias("changes"))
    now = F.lit("2024-01-31").cast("timestamp")
    return u.select("user_id", fn.freshness_state("ok", "last", "present", ["click", "error"], "changes", now, 86400.0).alias("state"))


@query("sequence_gaps", """with s as (select o_orderkey % 977 as number, count(*) as n from orders where o_orderkey % 977 % 50 <> 7 group by 1)
    select number, case when number < 10 or number > 950 then 'OUT_OF_RANGE' else 'DUPLICATE' end as problem, n from s where number < 10 or number > 950 or n > 1
    union all select r, 'MISSING', 0 from (select unnest(range(10, 951)) as r) where r not in (select number from s)""")
def sequence_gaps(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders").select((F.col("o_orderkey") % 977).alias("number")).where("number % 50 <> 7")
    return identity.sequence_gaps(o, "number", 10, 950)


@query("listed_members", "with l as (select conv_id, string_agg(role, ', ' order by turn) as roles from conversations group by 1), m as (select conv_id, trim(unnest(string_split(roles, ','))) as member from l) select conv_id, member, count(*) as n from m where member <> '' group by 1, 2")
def listed_members(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ", ").alias("roles"))
    return identity.listed_members(c, "roles").groupBy("conv_id", "member").agg(F.count(F.lit(1)).alias("n"))


_CLASSES_SQL = """with g as (select o_custkey, count(o_orderpriority) as n, bool_and(o_orderpriority = '1-URGENT') as a, bool_or(o_orderpriority = '1-URGENT') as o, array_to_string(list_sort(list(o_orderpriority)), ',') as positions from orders group by 1)
    select o_custkey, n as n_candidates, positions, case when n = 1 then 'ONE' when a then 'MANY_1-URGENT' when o then 'MIXED' else 'OTHER' end as class from g"""


@query("candidate_classes", _CLASSES_SQL)
@query("candidate_classes_all", _CLASSES_SQL)
def candidate_classes(spark: SparkSession, sf: str) -> DataFrame:
    """AG-41. Every customer of orders, under the query's first and second name."""
    out = identity.candidate_classes(load(spark, sf, "orders").select("o_custkey", F.col("o_orderpriority").alias("pos")), ["o_custkey"], "pos", "1-URGENT")
    return out.withColumn("positions", F.array_join("positions", ","))


@query("alias_audit", "with c as (select c_mktsegment as source, case when c_custkey % 500 = 3 then 'odd' else lower(c_mktsegment) end as target from customer) select source, array_to_string(list_sort(list(distinct target)), ',') as targets, count(distinct target) as n_targets, count(*) as n_rows from c group by 1")
def alias_audit(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "customer").select(F.col("c_mktsegment").alias("source"), F.when(F.col("c_custkey") % 500 == 3, "odd").otherwise(F.lower("c_mktsegment")).alias("target"))
    return identity.alias_audit(c, "source", "target").withColumn("targets", F.array_join("targets", ","))


@query("null_profile", """with d as (select lang, case when n_chars % 7 = 0 then null else n_chars end as a, case when doc_id % 5 = 0 then null else source end as b from documents), g as (select lang, count(*) as n, count(*) filter (a is null) as na, count(*) filter (b is null) as nb, count(*) filter (a is null or b is null) as nn from d group by 1)
    select lang, 'a' as "column", n as n_rows, na as n_null, nn as n_any_null from g union all select lang, 'b', n, nb, nn from g""")
def null_profile(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents").selectExpr("lang", "case when n_chars % 7 = 0 then null else n_chars end as a", "case when doc_id % 5 = 0 then null else source end as b")
    return reshape.null_profile(d, ["a", "b"], ["lang"])


@query("text_functions", """with p as (select p_partkey, '  ' || p_name || ' Jr.' as name, p_brand, p_type, case p_partkey % 4 when 0 then ' 12 ' when 1 then '3.7' when 2 then 'NaN' else 'yes' end as raw from part)
    select p_partkey, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) as token, regexp_replace(trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')), ' jr$', '') as name_key, nullif(split_part(p_type, ' ', 2), '') as part_2, case p_partkey % 4 when 0 then 12 when 1 then 3 end as as_long, case p_partkey % 4 when 0 then 12.0 when 1 then 3.7 end as as_double,
           case p_partkey % 4 when 3 then true end as as_boolean, coalesce(case upper(p_brand) when 'BRAND#11' then 'ELEVEN' end, upper(p_brand)) as brand, p_partkey || ':' || p_brand as joined, sha256('{"p_brand":"' || p_brand || '","p_partkey":' || p_partkey || '}') as hash from p""")
def text_functions(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "part").selectExpr("*", "concat('  ', p_name, ' Jr.') as name", "case p_partkey % 4 when 0 then ' 12 ' when 1 then '3.7' when 2 then 'NaN' else 'yes' end as raw")
    return p.select("p_partkey", fn.token("name").alias("token"), fn.name_key("name").alias("name_key"), fn.id_part("p_type", 1, " ").alias("part_2"), fn.to_long("raw").alias("as_long"), fn.to_double("raw").alias("as_double"), fn.to_boolean("raw").alias("as_boolean"), fn.alias("p_brand", {"BRAND#11": "ELEVEN"}).alias("brand"), fn.joined_id("p_partkey", "p_brand").alias("joined"), fn.record_hash("p_partkey", "p_brand").alias("hash"))


@query("time_functions", """select event_id, epoch_us(timezone('America/New_York', date_trunc('minute', ts))) as utc, epoch_us(ts) as strict, round((epoch_us(timestamp '2024-02-01') - epoch_us(ts)) / 60e6, 4) as lead from events""")
def time_functions(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+0000"))
    return e.select("event_id", F.unix_micros(fn.local_to_utc(F.to_date("ts"), F.date_format("ts", "HH:mm"))).alias("utc"), F.unix_micros(fn.strict_timestamp(text)).alias("strict"), F.round(fn.minutes_between("ts", F.lit("2024-02-01").cast("timestamp")), 4).alias("lead"))


@query("quality_gates", """select 'counts' as gate, 'lines by order' as detail, count(*) as n from (select l_orderkey from lineitem group by 1 having count(*) > 7)
    union all select 'coverage', 'extra', count(*) from (select distinct l_orderkey from lineitem where l_orderkey not in (select o_orderkey from orders))
    union all select 'coverage', 'missing', count(*) from (select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem))
    union all select 'once', 'part by order', count(*) from (select l_orderkey, l_partkey from lineitem group by 1, 2 having count(*) > 1)
    union all select 'single_valued', 'status by customer', count(*) from (select o_custkey from orders group by 1 having count(distinct o_orderstatus) > 1)
    union all select 'unique_key', 'part', count(*) from (select l_partkey from lineitem group by 1 having count(*) > 1)
    union all select 'window', 'discount', count(*) from lineitem where l_discount > 0.08""")
def quality_gates(spark: SparkSession, sf: str) -> DataFrame:
    lines, orders = load(spark, sf, "lineitem"), load(spark, sf, "orders")
    keys = orders.select(F.col("o_orderkey").alias("l_orderkey"))
    both = quality.coverage(keys, lines.select("l_orderkey"), ["l_orderkey"])
    n = lambda df, gate, detail: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(gate).alias("gate"), F.lit(detail).alias("detail"), "n")
    per = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))
    gates = [
        n(both.where("detail like 'missing%'"), "coverage", "missing"),
        n(both.where("detail like 'extra%'"), "coverage", "extra"),
        n(quality.unique_key(lines, ["l_partkey"]), "unique_key", "part"),
        n(quality.once_per_block(lines, ["l_orderkey"], ["l_partkey"]), "once", "part by order"),
        n(quality.single_valued(orders, ["o_custkey"], "o_orderstatus"), "single_valued", "status by customer"),
        quality.in_window(lines, "l_discount", high=0.08).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("window").alias("gate"), F.lit("discount").alias("detail"), "n"),
        n(per.where("lines > 7"), "counts", "lines by order"),
    ]
    return reduce(DataFrame.unionByName, gates)


@query("table_manifest")
def table_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """No SQL: the fingerprint is Spark's hash. Tests hold it against shuffled and changed rows."""
    return quality.manifest({n: load(spark, sf, n) for n in ("orders", "lineitem", "events")})


@query("key_sets", "select 'both' as part, count(*) as n from (select o_custkey from orders intersect select c_custkey from customer) union all select 'customers only', count(*) from (select c_custkey from customer except select o_custkey from orders) union all select 'either', count(*) from (select o_custkey from orders union select c_custkey from customer)")
def key_sets(spark: SparkSession, sf: str) -> DataFrame:
    a, b = load(spark, sf, "orders").select(F.col("o_custkey").alias("k")), load(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return reshape.stacked([n(a.intersect(b), "both"), n(b.subtract(a), "customers only"), n(a.union(b).distinct(), "either")])
