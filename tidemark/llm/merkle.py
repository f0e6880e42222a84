"""A Merkle manifest of a dataset, and its versions by path copying.

The rows of a group (a source) are the leaves of a tree in ascending order of their key; every 16 consecutive nodes become
one, until one is left. The groups' roots, ordered by group, are the leaves of one more tree, whose root stands for the
whole dataset. The tree is persistent: an altered leaf makes a version of its own, which copies the leaf's ancestors and
shares every other node with the base.

Trees are cut into aligned blocks of `RUN ** levels` leaves, which one task folds. The blocks' roots are the leaves of the
next round, so that a tree of any size is spread over tasks and n leaves take log n / log(block) rounds. On the way back a
block learns its own path to the root, and the versions of its leaves copy their ancestors inside the block and go on
along that path: no task holds more than a block and a path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import new_path

RUN, LEVELS = 16, 3
_HEX = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NODE = "tree string, level int, pos long, n long, digest string, top boolean"
_PATHS = "tree string, name string, pos long, digest string, places array<int>, runs array<string>, subroot string, root string"
_ROWS = "tree string, id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, altered boolean, depth int, nodes array<long>, copies array<string>"


def leaf_digest(*columns: Column) -> Column:
    """The hash of one row: each value as its length in bytes, a colon and its UTF-8, or a dash if it is null."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)), 256)


def lowered(text: Column) -> Column:
    """The text with A to Z in lower case and all else as it is."""
    return F.translate(text, _UPPER, _LOWER)


def leaves(docs: DataFrame, columns: list[str], changed: dict[str, Column] | None = None, where: Column | bool = False, id_col: str = "doc_id", tree_col: str = "source") -> DataFrame:
    """tree, id, leaf and changed of each row: the hash of its columns, and where `where` holds that of the altered ones.

    changed: what replaces a column in the altered rows. Columns may have any names; those not listed are not hashed.
    """
    where = F.lit(where) if isinstance(where, bool) else where
    altered = leaf_digest(*((changed or {}).get(c, docs[c]) for c in columns))
    group = docs[tree_col].cast("string")
    return docs.select(
        F.when(group.isNull(), "0").otherwise(F.concat(F.lit("1"), group)).alias("tree"),  # null comes first
        docs[id_col].cast("long").alias("id"), leaf_digest(*(docs[c] for c in columns)).alias("digest"), F.when(where, altered).alias("changed"),
    )


def _stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again."""
    out = new_path(df.sparkSession, name)
    df.write.parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)


def _ranked(rows: DataFrame, order: list[Column]) -> tuple[DataFrame, int]:
    """rows with pos, the place in their tree, and n, its size; and the largest size.

    Ranges of (tree, order) are sorted in their tasks and written with their running number. A tree's count in each
    range then gives where the range begins in the tree, so that a tree of any size is in as many ranges as it needs.
    """
    by = [F.col("tree"), *order]
    numbered = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    numbered = _stored(numbered, "merkle-order").withColumn("_range", F.shiftright("_at", 33))
    spans = numbered.groupBy("tree", "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy("tree")
    before = F.coalesce(F.sum("_rows").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("tree", "_range", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(whole).alias("n"))
    largest = spans.agg(F.max("n")).first()[0]
    return numbered.join(spans, ["tree", "_range"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift"), largest or 0


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """The columns of consecutive rows of one tree and block."""
    held: dict[str, list] = {}
    for batch in batches:
        rows = {name: batch.column(name).to_pylist() for name in batch.schema.names}
        marks = list(zip(rows["tree"], rows["block"], strict=True))
        at = 0
        while at < len(marks):
            to = at + 1
            while to < len(marks) and marks[to] == marks[at]:
                to += 1
            part = {name: values[at:to] for name, values in rows.items()}
            if held and (held["tree"][0], held["block"][0]) == marks[at]:
                for name, values in part.items():
                    held[name] += values
            else:
                if held:
                    yield held
                held = part
            at = to
    if held:
        yield held


def _folded(digests: list[str], whole: bool, levels: int) -> tuple[list[list[str]], list[list[str]]]:
    """A block's nodes level by level, and the runs of each level as one string each. whole: the block is all of its tree."""
    nodes, runs = [digests], []
    while len(runs) < levels and (len(nodes[-1]) > 1 or not whole):
        runs.append(["".join(nodes[-1][k : k + RUN]) for k in range(0, len(nodes[-1]), RUN)])
        nodes.append([_hash(r) for r in runs[-1]])
    return nodes, runs


def _inner(levels: int, done: int):
    """Of each block its inner nodes; `top` marks the one that stands for the block."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches):
            tree, block, n = g["tree"][0], g["block"][0], g["n"][0]
            nodes, runs = _folded(g["digest"], n <= RUN**levels, levels)
            made = []
            for k in range(len(runs) + 1):
                top = k == len(runs)
                if k or top:
                    first, size = block * RUN ** (levels - k), -(-n // RUN**k)
                    made += [(tree, done + k, first + j, size, d, top) for j, d in enumerate(nodes[k])]
            columns = list(zip(*made, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True)], names=["tree", "level", "pos", "n", "digest", "top"])

    return rows


def _dealt(rows: DataFrame, levels: int) -> DataFrame:
    return rows.withColumn("block", F.shiftright("pos", 4 * levels))


@dataclass
class _Forest:
    """The rounds of some trees: the nodes that each begins with, and the roots, with the round that found each."""

    rounds: list[DataFrame]
    roots: DataFrame
    inner: DataFrame


def _grown(nodes: DataFrame, largest: int, levels: int) -> _Forest:
    rounds, roots, inner = [], [], []
    while True:
        k = len(rounds)
        rounds.append(nodes)
        dealt = _dealt(nodes.select("tree", "pos", "n", "digest"), levels).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
        inner.append(_stored(dealt.mapInArrow(_inner(levels, k * levels), _NODE), "merkle-nodes"))
        tops = inner[-1].where("top")
        roots.append(tops.where("n = 1").select("tree", "digest", F.lit(k).alias("round")))
        if largest <= RUN**levels:
            break
        nodes, largest = tops.where("n > 1").select("tree", "pos", "n", "digest"), -(-largest // RUN**levels)
    union = lambda frames: frames[0] if len(frames) == 1 else union([frames[0].unionByName(frames[1]), *frames[2:]])
    return _Forest(rounds, union(roots), union(inner))


def _with_paths(nodes: DataFrame, upper: DataFrame, levels: int) -> DataFrame:
    """nodes behind the one row of upper that has their block's path, ready to be streamed."""
    both = _dealt(nodes, levels).unionByName(upper.withColumn("pos", F.lit(-1).cast("long")), allowMissingColumns=True)
    return both.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _steps(g: dict[str, list], levels: int):
    """Of a group of _with_paths the levels of its nodes, and of each node its places and runs from the leaf to the root."""
    places, runs = g["places"][0], g["runs"][0]
    _, own = _folded(g["digest"][1:], g["n"][1] <= RUN**levels, levels)

    def path(k: int) -> tuple[list[int], list[str]]:
        return [(k >> 4 * j) % RUN for j in range(len(own))] + places, [own[j][k >> 4 * (j + 1)] for j in range(len(own))] + runs

    return len(own), path


def _path_rows(levels: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches):
            n = len(g["pos"]) - 1
            _, path = _steps(g, levels)
            for at in range(0, n, 256):
                ks = range(at, min(n, at + 256))
                made = [path(k) for k in ks]
                pick = lambda name: [g[name][1 + k] for k in ks]  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(pick("tree"), pa.string()), pa.array(pick("name"), pa.string()), pa.array(pick("pos"), pa.int64()), pa.array(pick("digest"), pa.string()),
                        pa.array([p for p, _ in made], pa.list_(pa.int32())), pa.array([r for _, r in made], pa.list_(pa.string())),
                        pa.array([g["subroot"][0]] * len(ks), pa.string()), pa.array([g["root"][0]] * len(ks), pa.string()),
                    ],
                    names=["tree", "name", "pos", "digest", "places", "runs", "subroot", "root"],
                )

    return rows


def _leaf_rows(levels: int):
    """Of each leaf its proof and the ancestors that its version copies, from the leaf's parent to the root."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches):
            subroot, root, depth, above = g["subroot"][0], g["root"][0], g["depth"][0], 0
            inside, path = _steps(g, levels)
            for j, p in enumerate(g["places"][0][depth:]):  # the place of the tree among all trees
                above += p * RUN**j
            depth += inside
            made = []
            for k, (pos, ident, leaf, changed) in enumerate(zip(g["pos"][1:], g["id"][1:], g["digest"][1:], g["changed"][1:], strict=True)):
                digest, proof, copies = changed or leaf, [], []
                places, runs = path(k)
                for p, run in zip(places, runs, strict=True):
                    left, right = run[: _HEX * p], run[_HEX * (p + 1) :]
                    proof += (left, right)
                    digest = _hash(left + digest + right)
                    copies.append(digest)
                nodes = [pos >> 4 * j if j <= depth else above >> 4 * (j - depth) for j in range(1, len(places) + 1)]
                version = (True, depth, nodes, copies) if changed else (False, depth, None, None)
                made.append((g["tree"][0], ident, leaf, subroot, root, _hash("".join(proof)), digest, *version))
            for at in range(0, len(made), 1024):
                kinds = (pa.string(), pa.int64(), *[pa.string()] * 5, pa.bool_(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.string()))
                names = ["tree", "id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "altered", "depth", "nodes", "copies"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made[at : at + 1024], strict=True), kinds, strict=True)], names=names)

    return rows


@dataclass
class Manifest:
    """rows: one for each leaf, with id, leaf, subroot, root, proof_sha256 (the hash of all siblings from the leaf to the
    root, left to right), folded_root (the root that the altered leaf, or else the leaf itself, folds up to), altered,
    depth (the levels of its own tree), and of an altered leaf's version nodes and copies, each ancestor's place and hash.

    base: the inner nodes of the trees (tree, level, pos, n, digest); of the tree of all trees, `tree` is null.
    """

    rows: DataFrame
    base: DataFrame


def manifest(rows: DataFrame, levels: int = LEVELS) -> Manifest:
    """The trees over rows of `leaves`, and each leaf's place in them.

    Leaves are in ascending order of id, a null id last; rows of one id in the order of their hash; equal rows each have a
    leaf. A null group is a group, the first of all. Without rows there are no trees. A tree of one leaf is that leaf.
    """
    ranked, largest = _ranked(_stored(rows, "merkle-leaves"), [F.col("id").asc_nulls_last(), F.col("digest"), F.col("changed")])
    forest = _grown(ranked, largest, levels)
    tops, n_trees = _ranked(forest.roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest", "round"), [F.col("name")])
    tops = _stored(tops, "merkle-roots")
    whole = _grown(tops, n_trees, levels)

    none = F.array().cast("array<int>").alias("places"), F.array().cast("array<string>").alias("runs")
    start = lambda k: F.lit(k).cast("long").alias("block")
    upper = whole.roots.select("tree", start(0), *none, F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    paths = _paths_down(whole.rounds, lambda k: upper if k == len(whole.rounds) - 1 else None, levels)
    found = paths.join(tops.select("name", "round"), "name")
    ends = lambda k: found.where(F.col("round") == k).select(F.col("name").alias("tree"), start(0), "places", "runs", F.col("digest").alias("subroot"), "root")
    last = ends(0) if len(forest.rounds) == 1 else _as_upper(_paths_down(forest.rounds[1:], lambda k: ends(k + 1), levels)).unionByName(ends(0))
    # depth, so far: the tree's own levels above the block
    last = last.withColumn("depth", F.size("places") - F.lit(_height(n_trees))).select("tree", "block", "places", "runs", "subroot", "root", "depth")
    made = _with_paths(ranked.select("tree", "pos", "n", "id", "digest", "changed"), last, levels).mapInArrow(_leaf_rows(levels), _ROWS)
    made = made.withColumn("verified", F.col("folded_root") == F.col("root"))
    inner = forest.inner.where("level > 0").unionByName(whole.inner.where("level > 0").withColumn("tree", F.lit(None).cast("string")))
    return Manifest(made, inner.drop("top"))


def _height(n: int) -> int:
    """The levels above n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // RUN), levels + 1
    return levels


def _as_upper(paths: DataFrame) -> DataFrame:
    return paths.select("tree", F.col("pos").alias("block"), "places", "runs", "subroot", "root")


def _paths_down(rounds: list[DataFrame], ends, levels: int) -> DataFrame:
    """The paths of the first round's nodes. ends(k): the upper paths of the trees that round k finishes."""
    upper = None
    for k in range(len(rounds) - 1, -1, -1):
        found = ends(k)
        upper = found if upper is None else upper if found is None else upper.unionByName(found)
        nodes = rounds[k] if "name" in rounds[k].columns else rounds[k].withColumn("name", F.lit(None).cast("string"))
        paths = _with_paths(nodes.select("tree", "name", "pos", "n", "digest"), upper, levels).mapInArrow(_path_rows(levels), _PATHS)
        upper = _as_upper(paths)
    return paths


def versions(made: Manifest) -> DataFrame:
    """The nodes that the versions copy: version (the altered leaf's id), tree, level, pos and digest. All others are the base's."""
    rows = made.rows.where("altered").select("id", "tree", "depth", F.posexplode(F.arrays_zip("nodes", "copies")).alias("k", "node"))
    own = F.col("k") < F.col("depth")
    return rows.select(F.col("id").alias("version"), F.when(own, F.col("tree")).alias("tree"), F.when(own, F.col("k") + 1).otherwise(F.col("k") + 1 - F.col("depth")).alias("level"), F.col("node.nodes").alias("pos"), F.col("node.copies").alias("digest"))


def at_version(base: DataFrame, copies: DataFrame, version: int) -> DataFrame:
    """All inner nodes as one version has them: its copies, and the base's nodes where it has none."""
    own = copies.where(F.col("version") == version).select("tree", "level", "pos", F.col("digest").alias("copy"))
    on = base["tree"].eqNullSafe(own["tree"]) & (base["level"] == own["level"]) & (base["pos"] == own["pos"])
    return base.join(F.broadcast(own), on, "left").select(base["tree"], base["level"], base["pos"], F.coalesce("copy", "digest").alias("digest"))
