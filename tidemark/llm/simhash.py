"""SimHash fingerprints over word shingles, linked at a small Hamming distance by bit-sliced comparison.

Fingerprints are first made distinct, so that copies cost nothing. Two fingerprints that differ in at most two
bits agree in two of four 16-bit blocks: each goes to six tables, keyed by a pair of blocks, and is compared
inside its bucket only. A bucket above `BUCKET` fingerprints is split in the same way by the 32 bits that are
still free (four blocks of eight bits); below that 16 bits are free, so no bucket exceeds 65,536 fingerprints.

Comparison is vertical. 64 fingerprints of a bucket form a block of 64 machine words, word b holding bit b of
each; against one query, the XOR of a word with the query's bit updates 64 distances at once in a saturating
carry-save counter (ones, twos, over). After every eight planes, blocks in which all lanes are over the radius
are abandoned.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LAST_ID, checkpointed, keyed, looked_up, mixed, real_id, released, slices, texts_of
from tidemark.llm.components import components

SHINGLE, RADIUS, BUCKET, ITEMS, CHUNK = 3, 2, 4096, 1 << 17, 1 << 20
_SPACES = [bytes([c]) for c in (32, *range(9, 14))]


def _word_lists(text: bytes, size: int) -> Iterator[list[bytes]]:
    """The words of the text, in pieces of about `size` bytes."""
    at = 0
    while len(text) - at > size:
        to = at + size
        cut = max(text.rfind(c, at, to) for c in _SPACES)
        if cut <= at:  # no white space, so on to the next
            cut = min((x for c in _SPACES if (x := text.find(c, to)) >= 0), default=len(text))
        yield text[at:cut].split()
        at = cut
    yield text[at:].split()


def _hashes(words: list[bytes], width: int) -> np.ndarray:
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.array([h(joined[a:b], 42) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64)


def _shingles(text: bytes, width: int, size: int = CHUNK) -> Iterator[np.ndarray]:
    """The XXH64 (seed 42) of each shingle, repeats included, in pieces; of the whole sequence if it is shorter."""
    held: list[bytes] = []
    made = False
    for words in _word_lists(text.lower(), size):  # lower() and split() know only ASCII here
        held += words
        if len(held) >= width:
            yield _hashes(held, width)
            held, made = held[len(held) - width + 1 :], True
    if held and not made:
        yield _hashes(held, len(held))


def _fingerprint(parts: Iterable[np.ndarray]) -> int:
    total, n = np.zeros(64, np.int64), 0
    for hashes in parts:
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """_id, _tag and fingerprint (the 64 bits as a long) of each row. A text without words has fingerprint zero."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            made = np.array([_fingerprint(_shingles(t, width)) for t in texts_of(part, "_text")], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_tag"), pa.array(made.view(np.int64))], names=["_id", "_tag", "fingerprint"])

    return keyed(docs, id_col, text_col).mapInArrow(rows, "_id long, _tag long, fingerprint long")


def _bits(c: Column, at: int, n: int) -> Column:
    return F.shiftrightunsigned(c, at).bitwiseAND(F.lit((1 << n) - 1))


def _pair_keys(c: Column, blocks: list[int], n: int) -> list[Column]:
    """A struct (table, key) for each pair of the blocks of n bits that begin at these bits."""
    return [F.struct(F.lit(t).alias("table"), F.shiftleft(_bits(c, a, n), n).bitwiseOR(_bits(c, b, n)).alias("key")) for t, (a, b) in enumerate(combinations(blocks, 2))]


def _transposed(values: np.ndarray) -> np.ndarray:
    """values: (blocks, 64) fingerprints; out[b, k] holds bit b of the 64 fingerprints of block k."""
    out = np.empty((64, len(values)), np.uint64)
    for b in range(64):
        out[b] = np.packbits(((values >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def _compare(planes: np.ndarray, block: np.ndarray, query: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each item (a query against a block): which items still stand, and their lanes within the radius.

    The counters begin at 2**k - 1 - radius, so that one more than the radius is what overflows k planes.
    """
    depth = max(1, (radius + 1).bit_length())
    full, none = np.uint64(2**64 - 1), np.uint64(0)
    item, over = np.arange(len(block)), np.zeros(len(block), np.uint64)
    count = [np.full(len(block), full if (2**depth - 1 - radius) >> k & 1 else none) for k in range(depth)]
    for b in range(64):
        carry = planes[b, block] ^ (none - ((query >> np.uint64(b)) & np.uint64(1)))
        for k in range(depth):
            carry, count[k] = carry & count[k], count[k] ^ carry
        over |= carry
        if b % 8 == 7 and b < 63 and not (live := over != full).all():
            item, block, query, over = (x[live] for x in (item, block, query, over))
            count = [c[live] for c in count]
    return item, ~over


def _bucket_links(values: np.ndarray, starts: np.ndarray, radius: int, items: int = ITEMS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of values within the radius, the earlier first, in buckets that begin at starts."""
    size = np.diff(np.append(starts, len(values)))
    n_blocks = -(-size // 64)
    first_block = np.cumsum(n_blocks) - n_blocks
    bucket = np.repeat(np.arange(len(size)), size)
    lane = np.arange(len(values)) - starts[bucket]
    padded = np.zeros((n_blocks.sum(), 64), np.uint64)
    padded[first_block[bucket] + lane // 64, lane % 64] = values
    planes = _transposed(padded)
    del padded
    ends = np.cumsum(n_blocks[bucket])
    at = 0
    while at < len(values):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + items, side="right")))
        own = np.arange(at, to)
        count = n_blocks[bucket[own]]
        query = np.repeat(own, count)
        block = np.repeat(first_block[bucket[own]], count) + np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count)
        item, near = _compare(planes, block, values[query], radius)
        hit = near != 0
        item, near = item[hit], near[hit]
        lanes = np.unpackbits(near.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, lane_of = np.nonzero(lanes)
        left, blk = query[item[row]], block[item[row]]
        right = starts[bucket[left]] + 64 * (blk - first_block[bucket[left]]) + lane_of
        inside = (right < starts[bucket[left]] + size[bucket[left]]) & (left < right)
        yield left[inside], right[inside]
        at = to


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by table and key, in pieces that cut no bucket, with the start of each bucket."""

    def cut_at(table: pa.Table) -> np.ndarray:
        kind, key = table.column("table").to_numpy(), table.column("key").to_numpy()
        return np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (kind[1:] != kind[:-1])))

    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        last = int(cut_at(table)[-1])  # the next batch may go on with it
        if last:
            yield (whole := table.slice(0, last)), cut_at(whole)
        rest = table.slice(last)
    if rest is not None:
        yield rest, np.zeros(1, np.int64)


def _link_rows(radius: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _by_bucket(batches):
            values = table.column("fingerprint").to_numpy()
            for a, b in _bucket_links(values.view(np.uint64), starts, radius):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(values[a]), pa.array(values[b])], names=["a", "b"])

    return rows


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs a, b of different fingerprints that differ in `radius` bits at most, each once.

    prints: distinct longs in a column `fingerprint`. A fingerprint has at most 2,080 others within two bits of
    both it and each other, so the pairs grow with the fingerprints.
    """
    if not 0 <= radius <= 2:
        raise ValueError("the tables are laid out for a radius of 0 to 2")
    fp = F.col("fingerprint")
    coarse = prints.select(fp, F.explode(F.array(*_pair_keys(fp, [0, 16, 32, 48], 16))).alias("t")).select("fingerprint", F.col("t.table").alias("table"), F.col("t.key").alias("key"))
    sizes = coarse.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = coarse.join(sizes, ["table", "key"])
    small = held.where(F.col("n") <= BUCKET).select("table", "key", "fingerprint")
    # the 32 bits that table t does not hold
    fine = []
    for t, (a, b) in enumerate(combinations([0, 16, 32, 48], 2)):
        free = [x + y for x in (0, 16, 32, 48) if x not in (a, b) for y in (0, 8)]
        fine.append(F.when(F.col("table") == t, F.array(*_pair_keys(fp, free, 8))))
    large = held.where(F.col("n") > BUCKET).select("fingerprint", "table", "key", F.explode(F.coalesce(*fine)).alias("t"))
    large = large.select((F.lit(6) + F.col("table") * 6 + F.col("t.table")).cast("int").alias("table"), F.shiftleft(F.col("key"), 16).bitwiseOR(F.col("t.key")).alias("key"), "fingerprint")
    buckets = small.unionByName(large).repartition("table", "key").sortWithinPartitions("table", "key", "fingerprint")
    return buckets.mapInArrow(_link_rows(radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """_id, _tag, doc_id, fingerprint (long) and component_id, the smallest doc_id reachable by links.

    Texts without words (null, empty, white space) all have fingerprint zero and are linked like any other.
    Rows with a null doc_id take part; they give their component its id only if it has no other.
    """
    prints = checkpointed(fingerprints(docs, id_col, text_col, width))
    return _grouped(prints, "fingerprint", links(prints.select("fingerprint").distinct(), radius))


def _grouped(prints: DataFrame, node: str, pairs: DataFrame) -> DataFrame:
    """_id, _tag, doc_id, fingerprint, component_id and first (whether the row stands for its component) of prints, whose rows of one node belong together."""
    least = F.struct("_id", "_tag")
    smallest = prints.groupBy(node).agg(F.min(least).alias("smallest"))
    found = components(pairs).withColumnRenamed("node", "_node")
    labels = smallest.join(found, smallest[node] == found["_node"], "left").select(node, "smallest", F.coalesce("component", F.col(node)).alias("component"))
    first = labels.groupBy("component").agg(F.min("smallest").alias("_first"))
    named = labels.select(node, "component").join(first, "component").select(node, "_first")
    joined = looked_up(prints.select("_id", "_tag", "fingerprint", *({node} - {"fingerprint"})), [node], named)
    component = F.when(F.col("_first._id") != LAST_ID, F.col("_first._id")).alias("component_id")
    return joined.select("_id", "_tag", real_id(), "fingerprint", component, (least == F.col("_first")).alias("first"))


#: Min-hash rows of a sketch: BANDS bands of BAND rows. Two texts of similarity s share a band with 1 - (1 - s**BAND)**BANDS.
BAND, BANDS = 6, 21
#: A pair at 0.8 is proposed unless its estimate is 0.12 (3.3 deviations) too low, or its fingerprints of distinct shingles differ in over 28 bits (mean 12 at most).
SIMILARITY, SLACK, REACH = 0.8, 0.12, 28
_MULTIPLIERS = np.random.default_rng(20).integers(0, 2**63, BAND * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sketch(hashes: np.ndarray) -> np.ndarray:
    out = np.full(BAND * BANDS, 2**32 - 1, np.uint64)
    for at in range(0, len(hashes), 1024):
        out = np.minimum(out, ((hashes[at : at + 1024, None] * _MULTIPLIERS) >> np.uint64(32)).min(0))
    return out


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """_id, _tag, fingerprint (of distinct shingles), node (a hash of their set), size (of that set), keys (one for each band) and sketch (16 bits of each min-hash)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            hashes = [_distinct(t, width) for t in texts_of(part, "_text")]
            prints = np.array([_fingerprint(np.array_split(h, 1 + len(h) // CHUNK)) for h in hashes], np.uint64)
            minima = np.stack([_sketch(h) for h in hashes])
            keys = [mixed(np.arange(BANDS, dtype=np.uint64) + np.uint64(1))]
            bands = minima.reshape(len(hashes), BANDS, BAND)
            key = np.broadcast_to(keys[0], bands.shape[:2])
            for k in range(BAND):
                key = mixed(key ^ bands[:, :, k])
            raw = [x.astype("<u2").tobytes() for x in minima & np.uint64(0xFFFF)]
            node = np.array([xxhash.xxh3_64_intdigest(h.tobytes()) for h in hashes], np.uint64)
            size = pa.array([len(h) for h in hashes], pa.int64())
            lists = pa.FixedSizeListArray.from_arrays(pa.array(key.reshape(-1).view(np.int64)), BANDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_tag"), pa.array(prints.view(np.int64)), pa.array(node.view(np.int64)), size, lists, pa.array(raw, pa.binary())], names=["_id", "_tag", "fingerprint", "node", "size", "keys", "sketch"])

    return keyed(docs, id_col, text_col).mapInArrow(rows, "_id long, _tag long, fingerprint long, node long, size long, keys array<long>, sketch binary")


def _distinct(text: bytes, width: int) -> np.ndarray:
    parts = list(_shingles(text, width))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _similar_rows(least: float, reach: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _by_bucket(batches):
            node, prints = table.column("node").to_numpy(), table.column("fingerprint").to_numpy().view(np.uint64)
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), "<u2").reshape(len(node), -1)
            label = np.arange(len(node))
            for left, right in _bucket_links(prints, starts, reach, items=1 << 13):
                apart = label[left] != label[right]
                left, right = left[apart], right[apart]
                alike = np.concatenate([np.zeros(0, bool), *((sketch[left[k : k + 4096]] == sketch[right[k : k + 4096]]).mean(1) >= least for k in range(0, len(left), 4096))])
                left, right = left[alike], right[alike]
                _, first = np.unique(np.stack([label[left], label[right]], 1), axis=0, return_index=True)
                joined, root = [], {}

                def find(x: int, root: dict[int, int] = root) -> int:
                    while root.get(x, x) != x:
                        x = root[x]
                    return x

                for a, b in zip(left[first].tolist(), right[first].tolist(), strict=True):
                    x, y = find(int(label[a])), find(int(label[b]))
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        joined.append((node[a], node[b]))
                if joined:
                    old = np.array(list(root))
                    new = np.arange(len(node))
                    new[old] = [find(int(x)) for x in old]
                    label = new[label]
                    a, b = map(np.array, zip(*joined, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return rows


def _with_sets(width: int):
    """Texts become the sorted hashes of their distinct shingles, eight bytes each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            sets = [_distinct(t, width).tobytes() for t in texts_of(part, "_text")]
            rest = [c for c in part.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(sets, pa.binary())], names=[*rest, "hashes"])

    return rows


def _exact_links(node: np.ndarray, label: np.ndarray, asks: np.ndarray, sketch: np.ndarray, sets: list[np.ndarray], similarity: float, least: float) -> list[tuple[int, int]]:
    """Links of Jaccard `similarity` or more, enough to join whatever such links connect among pairs of different labels
    of which one asks and whose sketches agree in `least`."""
    size, label, out = np.array([len(x) for x in sets]), np.unique(label, return_inverse=True)[1], []
    for i in range(1, len(node)):
        lo, hi = np.minimum(size[:i], size[i]), np.maximum(size[:i], size[i])
        other = np.flatnonzero((label[:i] != label[i]) & (asks[:i] | asks[i]) & (lo / np.maximum(hi, 1) >= similarity))
        alike = (sketch[other] == sketch[i]).mean(1)
        other, alike = other[alike >= least], alike[alike >= least]
        for j in other[np.argsort(-alike, kind="stable")].tolist():
            if label[j] == label[i]:
                continue
            shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if shared / (size[i] + size[j] - shared) >= similarity:
                label[label == label[i]] = label[j]
                out.append((int(node[i]), int(node[j])))
    return out


def _confirmed_rows(similarity: float, least: float):
    """Links of rows (table, key, node, label, asks, sketch, hashes) sorted by table and key, inside each key."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _by_bucket(batches):
            for at, to in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
                group = table.slice(at, to - at)
                asks = group.column("asks").to_numpy()
                order = np.argsort(~asks, kind="stable")
                node, first = np.unique(group.column("node").to_numpy()[order], return_index=True)  # a node may be there on both sides
                group = group.take(pa.array(order[first]))
                sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), "<u2").reshape(len(node), -1)
                sets = [np.frombuffer(h, np.uint64) for h in group.column("hashes").to_pylist()]
                found = _exact_links(node, group.column("label").to_numpy(), group.column("asks").to_numpy(), sketch, sets, similarity, least)
                if found:
                    a, b = map(np.array, zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return rows


#: Fingerprints of a bucket, and texts and shingles of a proposed group, that one task compares at once.
SPLIT, TEXTS, MOST_SHINGLES = 8192, 512, 1 << 22


def _buckets(nodes: DataFrame) -> DataFrame:
    """table, key, node, fingerprint and sketch of each band that nodes share.

    A band of more than SPLIT nodes is cut into blocks, and each pair of blocks is a bucket of its own.
    """
    banded = nodes.select("node", F.posexplode("keys").alias("table", "key"))
    sizes = banded.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = banded.join(sizes, ["table", "key"])
    blocks = F.ceil(F.col("n") / SPLIT)
    own = F.pmod(F.xxhash64("node"), blocks)
    held = held.select("table", "key", "node", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"), "n")
    pair = F.when(F.col("n") <= SPLIT, F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    return held.select("table", pair.alias("key"), "node").join(nodes.select("node", "fingerprint", "sketch"), "node")


def _confirmed(sets: DataFrame, similarity: float, least: float) -> DataFrame:
    """Links a, b of Jaccard `similarity` or more, enough to join whatever they connect in each group.

    sets: group, blocks, node, sketch, hashes; a group may be any share of the rows. Its texts are dealt to blocks
    at random, and linked inside each first. Of a group in several blocks, the texts that are not in its largest
    component so far are then compared with all others; one large group of near copies leaves few of these.
    """

    def linked(rows: DataFrame) -> DataFrame:
        dealt = rows.repartition("table", "key").sortWithinPartitions("table", "key", "node")
        return dealt.mapInArrow(_confirmed_rows(similarity, least), "a long, b long")

    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    key = lambda *c: F.when(F.col("blocks") == 1, F.col("group")).otherwise(F.xxhash64("group", *c))
    inside = checkpointed(linked(sets.select(F.lit(0).alias("table"), key(block).alias("key"), "node", F.col("node").alias("label"), F.lit(True).alias("asks"), "sketch", "hashes")))
    large = sets.where("blocks > 1").select("group", "blocks", "node")
    if large.isEmpty():
        return inside
    labels = large.join(components(inside).select("node", "component"), "node", "left").select("group", "blocks", "node", F.coalesce("component", "node").alias("label"))
    counts = labels.groupBy("group", "label").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("group").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("n"))
    main = main.where(F.col("all") > F.col("n")).select("group", "main", F.ceil((F.col("all") - F.col("n")) / TEXTS).alias("parts"))
    labels = checkpointed(labels.join(main, "group"))
    if labels.isEmpty():
        return inside
    rows = labels.join(sets.select("node", "sketch", "hashes"), "node").withColumn("block", block).withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")))
    asking = rows.where("label <> main").select("group", "node", "label", "sketch", "hashes", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("asks"))
    asked = rows.select("group", "node", "label", "sketch", "hashes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "block", F.lit(False).alias("asks"))
    across = asking.unionByName(asked)
    return inside.unionByName(linked(across.select(F.lit(0).alias("table"), F.xxhash64("group", "part", "block").alias("key"), "node", "label", "asks", "sketch", "hashes")))


def _told_apart(prints: DataFrame) -> DataFrame:
    """prints, where rows of one node that differ in size or fingerprint, and so in their sets, no longer share it.

    A node is a hash of 64 bits, which unlike sets come to share among some 10**10; with the fingerprint and the size
    that takes 128 bits. The least of them keeps the node, the others get one of their own.
    """
    own = F.struct("size", "fingerprint")
    odd = prints.groupBy("node").agg(F.min(own).alias("_least"), F.max(own).alias("_most")).where("_least <> _most").select(F.col("node").alias("_node"), "_least")
    if odd.isEmpty():
        return prints
    joined = prints.join(odd, prints["node"] == odd["_node"], "left")
    node = F.when(F.col("_least").isNull() | (own == F.col("_least")), F.col("node")).otherwise(F.xxhash64("node", "size", "fingerprint"))
    return checkpointed(joined.withColumn("node", node).select(*prints.columns))


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """The columns of near_duplicates, grouping texts whose sets of shingles have a Jaccard similarity of `similarity` or more.

    At 0.8, 64-bit fingerprints differ in some ten bits, which no table of equal blocks can reach. So buckets come from
    bands of min-hashes here; in a bucket the fingerprints of distinct shingles are compared bit-sliced at a radius of
    REACH bits, and pairs within it propose each other if their whole sketches (126 rows; the estimate deviates by
    0.036 at 0.8, hence SLACK) agree. Proposals only bring texts together: each link is then confirmed by the exact
    Jaccard of the two sets of shingle hashes, which are joined to the proposed groups, once for each different set.
    Equal sets are one node; texts without words have the empty set.
    """
    prints = _told_apart(checkpointed(sketches(docs, id_col, text_col, width)))
    nodes = prints.groupBy("node").agg(F.first("fingerprint").alias("fingerprint"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"), F.first("size").alias("size"), F.min(F.struct("_id", "_tag")).alias("who"))
    buckets = _buckets(nodes).repartition("table", "key").sortWithinPartitions("table", "key", "node")
    least = similarity - SLACK
    proposed = components(buckets.mapInArrow(_similar_rows(least, REACH), "a long, b long").distinct())
    members = checkpointed(nodes.join(proposed, "node").select("node", F.col("component").alias("group"), "size", "sketch", "who._id", "who._tag"))
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / TEXTS), F.ceil(F.sum("size") / MOST_SHINGLES))
    members = members.join(members.groupBy("group").agg(blocks.alias("blocks")), "group")
    texts = keyed(docs, id_col, text_col).join(members, ["_id", "_tag"]).select("group", "blocks", "node", "sketch", "_text")
    sets = texts.mapInArrow(_with_sets(width), "group long, blocks long, node long, sketch binary, hashes binary")
    sets = checkpointed(sets.dropDuplicates(["node"]))  # rows equal in doc_id and text
    released(docs.sparkSession)
    return _grouped(prints, "node", _confirmed(sets, similarity, least))
