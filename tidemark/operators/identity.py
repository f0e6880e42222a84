"""Matching rows that name the same thing differently."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.text import name_key


def pair_key(a: str, b: str) -> Column:
    """JN-09. The two names in order, so that a pair has one key."""
    return F.array_join(F.array_sort(F.array(a, b)), "|")


def matched_pairs(rows: DataFrame, games: DataFrame, on: list[str], row_pair: tuple[str, str], game_pair: tuple[str, str], game: str, ident: str) -> DataFrame:
    """JN-09, JN-21. rows with n_matches, the game if there is exactly one, and MATCHED, AMBIGUOUS or UNMATCHED."""
    g = games.select(*on, pair_key(*game_pair).alias("_pair"), F.col(game).alias("_game"))
    counted = g.groupBy(*on, "_pair").agg(F.count(F.lit(1)).alias("n_matches"), F.min("_game").alias("_game"))
    out = rows.withColumn("_pair", pair_key(*row_pair)).join(counted, [*on, "_pair"], "left")
    n = F.coalesce("n_matches", F.lit(0))
    state = F.when(n == 0, "UNMATCHED").when(n == 1, "MATCHED").otherwise("AMBIGUOUS")
    return out.select(*rows.columns, n.alias("n_matches"), F.when(n == 1, F.col("_game")).alias(game), state.alias("match_status"))


def guarded_join(left: DataFrame, right: DataFrame, keys: list[str], gate: str = "one_to_one") -> tuple[DataFrame, DataFrame]:
    """JN-08. The join, and the violations that say it isn't one to one; assert_clean before the rows are used.

    Both sides are dealt by key in as many parts as spark.sql.shuffle.partitions says, which stay as they are: left to the
    size of packed keys, they would be merged into as many as there are cores, and a task's memory would grow with the rows.
    """
    from tidemark import quality

    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = (df.repartition(parts, *keys) for df in (left, right))
    gates = quality.union(quality.unique_key(left, keys, f"{gate}:left"), quality.unique_key(right, keys, f"{gate}:right"), quality.coverage(left, right, keys, gate))
    return left.join(right, keys), gates


def crosswalk(rows: DataFrame, reference: DataFrame, ident: str, target: str, tiers: list[tuple[str, str, str]], name: tuple[str, str] | None = None, team: tuple[str, str] | None = None) -> DataFrame:
    """JN-10. rows' identity by the first tier (label, column, reference column) whose value the reference knows.

    A value that stands for two targets is a CONFLICT and ends the search. Last comes name and team, if given. Each
    tier is an aggregate of the reference joined on its value. Returns ident, target, method and status
    (MATCHED, CONFLICT, UNMATCHED).
    """
    out = rows
    found: list[tuple[str, str]] = []
    steps = [(label, F.col(c), F.col(r)) for label, c, r in tiers]
    if name and team:
        steps.append(("name_team", F.concat_ws("|", name_key(name[0]), F.upper(team[0])), F.concat_ws("|", name_key(name[1]), F.upper(team[1]))))
    for k, (label, own, theirs) in enumerate(steps):
        index = reference.select(theirs.cast("string").alias(f"_k{k}"), F.col(target).alias("_t")).where(F.col(f"_k{k}").isNotNull() & (F.trim(f"_k{k}") != ""))
        index = index.groupBy(f"_k{k}").agg(F.min("_t").alias(f"_t{k}"), F.count_distinct("_t").alias(f"_n{k}"))
        out = out.withColumn(f"_k{k}", own.cast("string")).join(index, f"_k{k}", "left")
        found.append((label, f"{k}"))
    pick = lambda make, last: reduce(lambda acc, x: F.when(F.col(f"_n{x[1]}") >= 1, make(x)).otherwise(acc), reversed(found), last)
    method = pick(lambda x: F.lit(x[0]), F.lit(None).cast("string"))
    status = pick(lambda x: F.when(F.col(f"_n{x[1]}") == 1, "MATCHED").otherwise("CONFLICT"), F.lit("UNMATCHED"))
    value = pick(lambda x: F.when(F.col(f"_n{x[1]}") == 1, F.col(f"_t{x[1]}")), F.lit(None).cast(dict(reference.dtypes)[target]))
    return out.select(ident, value.alias(target), method.alias("method"), status.alias("status"))


def canonical_names(rows: DataFrame, mapping: DataFrame, game: str, column: str, source: str, canonical: str) -> tuple[DataFrame, DataFrame]:
    """JN-11. rows with the game's canonical name in place of the source's, and violations: names that map to two, or to none."""
    from tidemark import quality

    groups = mapping.groupBy(game, source).agg(F.min(canonical).alias("_canon"), F.count_distinct(canonical).alias("_n"))
    joined = rows.join(groups.withColumnRenamed(source, column), [game, column], "left")
    unknown = joined.where(F.col("_n").isNull() & F.col(column).isNotNull())
    gates = quality.union(
        quality._violations(groups.where("_n > 1"), "alias_ambiguous", F.concat_ws(",", game, source), F.col("_n")),
        quality._violations(unknown.groupBy(game, column).count(), "alias_unknown", F.concat_ws(",", game, column), F.col("count")),
    )
    return joined.select(*(F.coalesce("_canon", F.col(column)).alias(c) if c == column else F.col(c) for c in rows.columns)), gates


def diagnosed(unmatched: DataFrame, games: DataFrame, day: str, team: str, opponent: str, location: str, game: str) -> DataFrame:
    """JN-23. Why a row found no game, by relaxing its key: LOCATION, OPPONENT or DATE mismatch, or NONE, and the game that it may be."""
    tiers = [("LOCATION_MISMATCH", [day, team, opponent]), ("OPPONENT_MISMATCH", [day, team]), ("DATE_MISMATCH", [team, opponent])]
    out = unmatched
    for k, (_, keys) in enumerate(tiers):
        out = out.join(games.groupBy(*keys).agg(F.min(game).alias(f"_g{k}")), keys, "left")
    state, link = F.lit("NONE"), F.lit(None).cast(dict(games.dtypes)[game])
    for k in reversed(range(len(tiers))):
        state = F.when(F.col(f"_g{k}").isNotNull(), tiers[k][0]).otherwise(state)
        link = F.coalesce(F.col(f"_g{k}"), link)
    return out.select(*unmatched.columns, state.alias("diagnosis"), link.alias(f"possible_{game}"))


def overridden(rows: DataFrame, overrides: DataFrame, key: list[str], value: str, exception: Column) -> tuple[DataFrame, DataFrame]:
    """JN-24. rows with exceptions' values from the overrides, and violations unless both name exactly the same keys."""
    from tidemark import quality

    o = overrides.select(*key, F.col(value).alias("_o"))
    out = rows.withColumn("_e", F.coalesce(exception, F.lit(False))).join(o, key, "left")
    fixed = out.select(*(F.when(F.col("_e"), F.col("_o")).otherwise(F.col(value)).alias(c) if c == value else F.col(c) for c in rows.columns))
    return fixed, quality.coverage(rows.where(exception), overrides, key, "override")


def listed_members(rows: DataFrame, column: str, sep: str = ",", name: str = "member") -> DataFrame:
    """JN-17. One row for each entry of a delimited list, trimmed; empty entries and null lists give none."""
    return rows.select("*", F.explode(F.split(column, sep)).alias("_m")).select(*rows.columns, F.trim("_m").alias(name)).where(F.col(name) != "")


def ordered_as(rows: DataFrame, wanted: DataFrame, key: str, ordinal: str) -> DataFrame:
    """JN-16. The wanted rows with their ordinal, for an orderBy at the sink."""
    return wanted.select(key, ordinal).join(rows, key, "left")


def candidate_classes(candidates: DataFrame, key: list[str], position: str, main: str) -> DataFrame:
    """AG-41. For each slot how many candidates, their positions in order, and NONE, ONE, MANY_<main>, MIXED or OTHER."""
    is_main = F.col(position) == main
    out = candidates.groupBy(*key).agg(F.count(position).alias("n_candidates"), F.array_sort(F.collect_list(position)).alias("positions"), F.bool_and(is_main).alias("_all"), F.bool_or(is_main).alias("_any"))
    n = F.col("n_candidates")
    state = F.when(n == 0, "NONE").when(n == 1, "ONE").when(F.col("_all"), f"MANY_{main}").when(F.col("_any"), "MIXED").otherwise("OTHER")
    return out.withColumn("class", state).drop("_all", "_any")


def alias_audit(rows: DataFrame, source: str, target: str) -> DataFrame:
    """AG-42. For each source name the targets it was mapped to, their number and its rows."""
    return rows.groupBy(source).agg(F.array_sort(F.collect_set(target)).alias("targets"), F.count_distinct(target).alias("n_targets"), F.count(F.lit(1)).alias("n_rows"))


def sequence_gaps(rows: DataFrame, number: str, low: int, high: int) -> DataFrame:
    """SRC-04. Duplicate, missing and out-of-range numbers of a sequence that ought to be low..high, with how often each occurs."""
    n = F.col(number)
    seen = rows.groupBy(n.cast("long").alias("number")).agg(F.count(F.lit(1)).alias("n"))
    odd = seen.select("number", F.when(~F.col("number").between(low, high) | F.col("number").isNull(), "OUT_OF_RANGE").when(F.col("n") > 1, "DUPLICATE").alias("problem"), "n").where("problem is not null")
    missing = rows.sparkSession.range(low, high + 1).withColumnRenamed("id", "number").join(seen, "number", "left_anti")
    return odd.unionByName(missing.select("number", F.lit("MISSING").alias("problem"), F.lit(0).cast("long").alias("n")))


def latest(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """WN-09. The first row of each key in the order."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_k = 1").drop("_k")
