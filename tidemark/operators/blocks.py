"""Ordered blocks of events: schedules, eligibility, exposure, splits, clusters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def schedule(events: DataFrame, order: list[str], ids: str, as_of: str | None = None) -> DataFrame:
    """WN-18. One row a block, numbered from 0 in the order of its key columns: ids sorted, their number, and its cutoff.

    n_cutoffs is over 1 where a block's events disagree about the cutoff. Ids of one block are gathered in a row,
    so a block must be small; the number of blocks may grow.
    """
    cutoff = [F.min(as_of).alias("as_of"), F.count_distinct(as_of).alias("n_cutoffs")] if as_of else []
    blocks = events.groupBy(*order).agg(F.array_sort(F.collect_set(ids)).alias("ids"), F.count_distinct(ids).alias("n_ids"), *cutoff)
    return numbered(blocks, order)


def numbered(blocks: DataFrame, order: list[str], name: str = "block_ord") -> DataFrame:
    """A dense number from 0; one row a block, so the single sorted partition is as long as the calendar."""
    return blocks.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("int"))


def with_block(events: DataFrame, blocks: DataFrame, order: list[str]) -> DataFrame:
    """WN-17. Events with their block's number."""
    return events.join(blocks.select(*order, "block_ord"), order)


def prior_pairs(blocks: DataFrame, block: str = "block_ord", as_of: str | None = None, available_at: str | None = None) -> DataFrame:
    """JN-05, JN-06. (target, source) for each strictly earlier block, available by the target's cutoff if the columns are given.

    Pairs are of blocks, not of rows: the calendar squared.
    """
    keep = [c for c in (as_of, available_at) if c]
    t = blocks.select(F.col(block).alias("target"), *(F.col(c).alias("_cut") for c in keep[:1]))
    s = blocks.select(F.col(block).alias("source"), *(F.col(c).alias("_avail") for c in keep[1:]))
    on = F.col("source") < F.col("target")
    if len(keep) == 2:
        on = on & (F.col("_avail") <= F.col("_cut"))
    return t.join(s, on).select("target", "source")


@dataclass
class Prior:
    """The earlier blocks of each target as nodes of a binary tree over the calendar: target, level, node, which covers the
    blocks node * 2**level and the 2**level - 1 after it. `levels` is how many levels there are."""

    nodes: DataFrame
    levels: int


def prior_nodes(blocks: DataFrame, block: str = "block_ord", as_of: str | None = None, available_at: str | None = None) -> Prior:
    """JN-05, JN-06. As prior_pairs, in log2 of the calendar's length nodes a target instead of a row for each earlier block.

    Blocks are numbered from 0, gaps allowed. With cutoffs, a block is earlier once it is available by the target's
    cutoff; availability must not fall from block to block, so that the available ones are the first ones.
    """
    numbers = blocks.select(F.col(block).cast("long").alias("target"), *([F.col(as_of).alias("_cut"), F.col(available_at).alias("_avail")] if as_of else []))
    end = F.col("target")
    if as_of:
        w = Window.orderBy("target")  # one row a block
        if not numbers.withColumn("_before", F.max("_avail").over(w.rowsBetween(Window.unboundedPreceding, -1))).where("_avail < _before").isEmpty():
            raise ValueError("a block is available before an earlier one")
        times = numbers.select(F.col("_cut").alias("_t"), F.lit(1).alias("_kind"), "target").unionByName(numbers.select(F.col("_avail").alias("_t"), F.lit(0).alias("_kind"), "target")).where("_t is not null")
        seen = F.max(F.when(F.col("_kind") == 0, F.col("target") + 1)).over(Window.orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0))
        numbers = times.withColumn("_seen", F.coalesce(seen, F.lit(0))).where("_kind = 1").select("target", "_seen")
        end = F.least("target", "_seen")
    numbers = numbers.select("target", end.alias("_end"))
    ends = numbers.agg(F.min("target").alias("least"), F.max("_end").alias("most")).first()
    if ends.least is not None and ends.least < 0:
        raise ValueError("blocks are numbered from 0")
    levels = max(1, int(ends.most or 0).bit_length())
    part = lambda k: F.when(F.shiftright("_end", k) % 2 == 1, F.struct(F.lit(k).alias("level"), (F.shiftright("_end", k) - 1).alias("node")))
    nodes = numbers.select(F.col("target").cast(dict(blocks.dtypes)[block]).alias("target"), F.explode(F.array_compact(F.array(*map(part, range(levels))))).alias("n"))
    return Prior(nodes.select("target", "n.level", "n.node"), levels)


def node_rows(per_block: DataFrame, levels: int, block: str = "block_ord") -> DataFrame:
    """per_block with level and node of each node that a target may ask for; only even nodes are."""
    part = lambda k: F.when(F.shiftright(F.col(block).cast("long"), k) % 2 == 0, F.struct(F.lit(k).alias("level"), F.shiftright(F.col(block).cast("long"), k).alias("node")))
    return per_block.withColumn("_n", F.explode(F.array_compact(F.array(*map(part, range(levels)))))).select("*", "_n.level", "_n.node").drop("_n")


def prior_sums(per_block: DataFrame, prior: Prior | DataFrame, by: list[str], sums: list[str], block: str = "block_ord") -> DataFrame:
    """target, by and the sums of per_block over the target's earlier blocks; rows equal in block and `by` add up.

    By nodes, each row is summed into at most log2 of the calendar's length nodes, and a target adds up as many; by
    pairs of blocks (prior_pairs), a row meets every later target.
    """
    added = [F.sum(c).alias(c) for c in sums]
    if isinstance(prior, DataFrame):
        return per_block.join(prior, per_block[block] == prior["source"]).groupBy("target", *by).agg(*added)
    nodes = node_rows(per_block.select(block, *by, *sums), prior.levels, block).groupBy("level", "node", *by).agg(*added)
    return nodes.join(prior.nodes, ["level", "node"]).groupBy("target", *by).agg(*added)


def panel(rows: DataFrame, pairs: DataFrame, block: str = "block_ord") -> DataFrame:
    """WN-16. Training rows of each target block; expanded only where a fit needs the rows themselves."""
    return rows.join(pairs, rows[block] == pairs["source"]).drop("source")


def exposure(rows: DataFrame, blocks: DataFrame, completed: Column, season: str, block: str = "block_ord") -> DataFrame:
    """WN-08. For each block: rows, completed rows and blocks with any strictly before it, and the seasons they span."""
    per = rows.groupBy(block).agg(F.count(F.lit(1)).alias("n"), F.count_if(completed).alias("done"), F.min(season).alias("lo"), F.max(season).alias("hi"))
    w = Window.orderBy(block).rangeBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = blocks.select(block).distinct().join(per, block, "left")
    return out.select(block, zero(F.sum("n").over(w)).alias("prior_rows"), zero(F.sum("done").over(w)).alias("prior_completed"), zero(F.count("n").over(w)).alias("prior_blocks"), F.min("lo").over(w).alias("first_season"), F.max("hi").over(w).alias("last_season"))


def fit_split(rows: DataFrame, completed: Column, validation: int = 2, least_validation: int = 21, fit_blocks: int = 2, least_fit: int = 32, block: str = "block_ord") -> DataFrame:
    """WN-15. For each block of rows: the last block to fit on, the first and last to validate on, and why it is warm-up (null if it isn't).

    The last `validation` earlier blocks with a completed row validate, and hold `least_validation` of them at least; the
    blocks before those fit, and are `fit_blocks` with `least_fit` rows at least. Blocks need not be numbered without gaps.
    """
    per = rows.groupBy(block).agg(F.count_if(completed).alias("_n"))
    played = F.when(F.col("_n") > 0, F.struct(F.col(block).alias("b"), F.col("_n").alias("n")))
    w = Window.orderBy(block)  # one row a block
    # the played blocks so far, and of the block at hand those before it
    so_far = per.withColumns({"_k": F.sum((F.col("_n") > 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), "_rows": F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), "_p": played})
    # the last validation + 1 played blocks: of blocks without a row a frame of rows would lose some, so they are carried
    last = so_far.where("_n > 0").select(F.col(block).alias("_b"), F.collect_list("_p").over(w.rowsBetween(-validation, 0)).alias("_tail"))
    tails = last.select(F.col("_b").alias(block), "_tail").join(so_far.select(block), block, "right").withColumn("_tail", F.last("_tail", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    out = so_far.join(tails, block)
    tail = F.slice("_tail", F.greatest(F.size("_tail") - validation + 1, F.lit(1)), F.lit(validation))
    blocks_before, total = F.coalesce("_k", F.lit(0)), F.coalesce("_rows", F.lit(0))
    validating = F.coalesce(F.aggregate(tail, F.lit(0).cast("long"), lambda a, x: a + x["n"]), F.lit(0))
    reason = (
        F.when(blocks_before < validation, "too_few_validation_blocks").when(validating < least_validation, "too_few_validation_rows")
        .when(blocks_before - validation < fit_blocks, "too_few_fit_blocks").when(total - validating < least_fit, "too_few_fit_rows")
    )
    ok = lambda c: F.when(reason.isNull(), c)
    fit_last = F.element_at("_tail", F.greatest(F.size("_tail") - validation, F.lit(1)))["b"]
    return out.select(block, ok(fit_last).alias("fit_last"), ok(tail[0]["b"]).alias("validate_first"), ok(F.element_at(tail, -1)["b"]).alias("validate_last"), reason.alias("warmup_reason"))


def anchored_clusters(events: DataFrame, key: list[str], time: str, minutes: int, ident: str) -> DataFrame:
    """WN-14. Greedy clusters: an event joins the open cluster while it is within `minutes` of the cluster's start.

    Returns key, cluster_start, n and ids. Each key's events are sorted by time and streamed, and only the start of the
    open cluster is carried, so a key may hold any number of events; session windows do something else, as they
    measure from the last event. Null keys are keys; events without a time are left out.
    """
    span = minutes * 60_000_000
    timed = events.select(*key, F.unix_micros(F.col(time).cast("timestamp")).alias("_t"), F.col(ident).alias("_id")).where("_t is not null")
    timed = timed.withColumn("_key", F.to_json(F.struct(*key)))
    ordered = timed.repartition("_key").sortWithinPartitions("_key", "_t", "_id")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, start = None, 0
        for batch in batches:
            starts = []
            for name, t in zip(batch.column("_key").to_pylist(), batch.column("_t").to_pylist(), strict=True):
                if name != at or t - start > span:
                    at, start = name, t
                starts.append(start)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts, pa.int64())], names=[*batch.schema.names, "_start"])

    schema = T.StructType([*ordered.schema.fields, T.StructField("_start", T.LongType())])
    placed = ordered.mapInArrow(rows, schema)
    found = placed.groupBy("_key", *key, "_start").agg(F.count(F.lit(1)).cast("int").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("_t", "_id"))), lambda x: x["_id"]).alias("ids"))
    return found.select(*key, F.timestamp_micros("_start").alias("cluster_start"), "n", "ids")
