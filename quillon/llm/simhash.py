"""SimHash near-duplicates by the pigeonring principle.

Fingerprints are 64 bits wide. Cut into m segments placed on a ring, with segment budgets t
that sum to tau - m + 1, two fingerprints that differ in at most tau bits must own a start
segment from which *every* chain of l consecutive segments differs in at most
(sum of its budgets) + l - 1 bits. The first link of that chain is found by equality on
masked segments, longer chains prune what is left, and only then comes the Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_digest

from quillon.llm.common import free_name, hot_join, ship_code, stored
from quillon.llm.graph import components

SEED = 42
#: Ways to cut the ring: widths, and budgets that sum to distance - segments + 1.
CUTS = {4: (16, 16, 16, 16), 3: (21, 21, 22), 2: (32, 32)}
#: Rows with one key that one comparison unit holds; larger buckets are compared block against block.
BLOCK = 4096
#: Units of more rows grow trees from node to node; in smaller ones all rows shift along each other. Both try the same chains.
LARGE = 256
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: bytes | None, shingle: int) -> bytes:
    """Eight bytes for each shingle of one UTF-8 text, in order; nothing where it has no word."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return b""
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_digest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes) + np.arange(len(words))
    starts = (ends - sizes)[: 1 - shingle].tolist()
    return b"".join(map(xxh64_digest, map(joined.__getitem__, map(slice, starts, ends[shingle - 1 :].tolist())), repeat(SEED)))


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """SimHash of one UTF-8 text; 0 where it has no word. Repeated shingles count again."""
    total = np.zeros(64, np.int64)
    hashes = np.frombuffer(shingle_hashes(text, shingle), np.uint8).reshape(-1, 8)
    for i in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(hashes[i : i + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.array([fingerprint(t, shingle) for t in batch.column(2).cast(pa.binary()).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["doc_id", "text_hash", "fp"])


def budgets(segments: int, distance: int) -> list[int]:
    """Integers that sum to distance - segments + 1, as even as can be, the larger first."""
    total = distance - segments + 1
    return [total // segments + (i < total % segments) for i in range(segments)]


def plan(nodes: int, distance: int) -> int:
    """The number of segments that costs least over so many distinct fingerprints.

    Rows to shuffle grow with the masks of a cut; pairs to compare shrink with its key width.
    """

    def cost(m: int) -> float:
        total = 0.0
        for width, t in zip(CUTS[m], budgets(m, distance), strict=True):
            total += comb(width, t) * (nodes + 0.01 * nodes * nodes / 2.0 ** (width - t + 1))
        return total

    fit = [m for m in CUTS if m <= distance + 1]
    return min(fit, key=cost) if fit else 0  # no distance, nothing to link


def _segments(m: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment from the low bits up."""
    widths = CUTS[m]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def _masks(m: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """For each key: the bits of the fingerprint that it holds, and its start segment."""
    masks, starts = [], []
    for i, ((shift, width), t) in enumerate(zip(_segments(m), budgets(m, distance), strict=True)):
        for hidden in combinations(range(width), t):
            bits = (1 << width) - 1
            for h in hidden:
                bits ^= 1 << h
            masks.append(bits << shift)
            starts.append(i)
    return np.array(masks, np.uint64), np.array(starts)


def _keys(batches: Iterator[pa.RecordBatch], m: int, distance: int) -> Iterator[pa.RecordBatch]:
    masks, starts = _masks(m, distance)
    shifts = np.array([_segments(m)[i][0] for i in starts], np.uint64)
    slots = np.arange(len(masks), dtype=np.uint64) << np.uint64(40)
    step = max(1, 200_000 // len(masks))
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(fps), step):
            part = fps[at : at + step]
            keys = ((part[:, None] & masks) >> shifts) | slots
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(part, len(masks)).view(np.int64))], ["key", "fp"]
            )


class Forest:
    """Disjoint sets over the fingerprints that one task links."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def joins(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _chain_ok(x: np.ndarray, start: np.ndarray, m: int, distance: int) -> np.ndarray:
    """Positions of the differences `x` that pass every chain from their start segment, then the whole distance."""
    t, segs = budgets(m, distance), _segments(m)
    left = np.arange(len(x))
    for i in range(m):
        here = left[start[left] == i]
        spent, budget = np.zeros(len(here), np.int64), 0
        for length in range(1, m + 1):
            shift, width = segs[(i + length - 1) % m]
            budget += t[(i + length - 1) % m]
            spent = spent + np.bitwise_count((x[here] >> np.uint64(shift)) & np.uint64((1 << width) - 1))
            good = spent <= budget + length - 1
            here, spent = here[good], spent[good]
        left = np.concatenate([left[start[left] != i], here])
    return left


def chains_pass(spent: np.ndarray, distance: int) -> np.ndarray:
    """Of rows of differing bits by segment, those that pass every chain from some start: all within `distance`, and no other."""
    segments = spent.shape[1]
    over, good = spent - np.array(budgets(segments, distance)), np.zeros(len(spent), bool)
    for start in range(segments):
        left = np.flatnonzero(~good)
        total = np.zeros(len(left), np.int64)
        for length in range(segments):
            total = total + over[left, (start + length) % segments]
            passed = total <= length
            left, total = left[passed], total[passed]
        good[left] = True
    return good


def _near(group: np.ndarray, start: int, m: int, distance: int) -> Iterator[tuple[int, int]]:
    """Spanning links of one large bucket: each reached node tries its chains only on nodes not reached yet."""
    rest = group
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            node = front.pop()
            close = np.zeros(len(rest), bool)
            close[_chain_ok(rest ^ node, np.full(len(rest), start), m, distance)] = True
            if close.any():
                found = rest[close]
                rest = rest[~close]
                front.extend(found)
                yield from zip(repeat(int(node)), found.tolist())


def _links(batches: Iterator[pa.RecordBatch], m: int, distance: int) -> Iterator[pa.RecordBatch]:
    _, starts = _masks(m, distance)
    forest, out = Forest(), []

    def run(unit: np.ndarray, keys: np.ndarray, fps: np.ndarray) -> None:
        """unit: number of the comparison unit of each row, ascending."""
        edges = np.flatnonzero(np.diff(unit)) + 1
        first = np.concatenate([[0], edges])
        size = np.diff(np.concatenate([first, [len(unit)]]))
        for at, n in zip(first[size > LARGE].tolist(), size[size > LARGE].tolist()):
            start = int(starts[int(keys[at : at + 1].view(np.uint64)[0] >> np.uint64(40))])
            out.extend((a, b) for a, b in _near(fps[at : at + n], start, m, distance) if forest.joins(a, b))
        size = np.where(size > LARGE, 1, size)
        rest = np.repeat(size, np.diff(np.concatenate([first, [len(unit)]])))  # rows of a unit that is done count as alone
        place = np.arange(len(unit)) - np.repeat(first, np.diff(np.concatenate([first, [len(unit)]])))
        alive = np.flatnonzero(place + 1 < rest)
        step = 1
        while len(alive):
            x = fps[alive] ^ fps[alive + step]
            slot = (keys[alive].view(np.uint64) >> np.uint64(40)).astype(np.int64)
            for i in _chain_ok(x, starts[slot], m, distance).tolist():
                a, b = int(fps[alive[i]]), int(fps[alive[i] + step])
                if a != b and forest.joins(a, b):
                    out.append((a, b))
            step += 1
            alive = alive[place[alive] + step < rest[alive]]

    def flush() -> Iterator[pa.RecordBatch]:
        if out:
            pairs = np.array(out, np.uint64).view(np.int64)
            out.clear()
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for batch in batches:
        key, unit, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(key):
            continue
        kept.append((key, unit, fp.view(np.uint64)))
        if kept[0][0][0] == key[-1] and kept[0][1][0] == unit[-1]:
            continue  # the unit still goes on
        key, unit, fp = (np.concatenate(x) for x in zip(*kept))
        change = np.concatenate([[False], (key[1:] != key[:-1]) | (unit[1:] != unit[:-1])])
        number, cut = np.cumsum(change), np.flatnonzero(change)[-1]
        run(number[:cut], key[:cut], fp[:cut])
        kept = [(key[cut:], unit[cut:], fp[cut:])]
        yield from flush()
    if kept:
        key, unit, fp = (np.concatenate(x) for x in zip(*kept))
        run(np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (unit[1:] != unit[:-1])])), key, fp)
    yield from flush()


def block_pairs(blocks: Column, mine: Column) -> Column:
    """Numbers of the units of two blocks that the block `mine` is in; one unit where there are no blocks."""
    others = F.filter(F.sequence(F.lit(0), blocks - 1), lambda i: i != mine)
    units = F.transform(others, lambda i: F.least(i, mine) * blocks + F.greatest(i, mine))
    return F.when(blocks.isNull(), F.array(F.lit(0))).otherwise(units)


def fingerprint_links(nodes: DataFrame, distance: int = 4) -> DataFrame:
    """(a, b): links that connect the distinct fingerprints `nodes.fp` exactly as all pairs within `distance` do.

    A task returns a spanning forest of what it finds, never all pairs of a group. Buckets of
    more than BLOCK rows are cut into blocks by a hash; every pair of blocks is one unit, so no
    unit outgrows a task and no pair is lost.
    """
    count = nodes.count()
    m = plan(count, distance)
    if not m:
        return nodes.sparkSession.createDataFrame([], "a long, b long")
    spread = max(nodes.rdd.getNumPartitions(), nodes.sparkSession.sparkContext.defaultParallelism)
    keys = nodes.select("fp").repartition(spread, "fp").mapInArrow(partial(_keys, m=m, distance=distance), "key long, fp long")
    heavy = keys.groupBy("key").count().where(F.col("count") > BLOCK).withColumn("n", F.ceil(F.col("count") * 2 / BLOCK).cast("int"))
    heavy = stored(heavy.select("key", "n"), "heavy")
    if heavy.isEmpty():
        keys = keys.withColumn("unit", F.lit(0))
    else:
        units = block_pairs(F.col("n"), F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
        keys = keys.join(heavy, "key", "left").select("key", "fp", F.explode(units).alias("unit"))
    shuffled = keys.select("key", "unit", "fp").repartition("key", "unit").sortWithinPartitions("key", "unit")
    return shuffled.mapInArrow(partial(_links, m=m, distance=distance), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """One row per row of `docs`: doc_id, text_hash, fingerprint, component_id, is_kept.

    component_id is the smallest id reachable over links of fingerprints that differ in at
    most `distance` bits. is_kept marks the rows with the smallest (id, text hash) of their
    component; only repeated rows share that mark. A null or empty text has fingerprint zero
    and links like any other; a null id counts as larger than all others (component_id is null
    only if the whole component has no id). Texts count whole, however long. An empty table gives
    no rows. Other columns of `docs` are not read. A distance of 0 links equal fingerprints alone.
    """
    spark = docs.sparkSession
    ship_code(spark)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    fps = stored(own.mapInArrow(partial(_fingerprints, shingle=shingle), "doc_id long, text_hash long, fp long"), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    nodes = stored(fps.groupBy("fp").agg(first), "nodes")
    labels = components(fingerprint_links(nodes, distance), "a", "b")
    return with_components(fps, nodes, labels, "fp").select(
        "doc_id",
        "text_hash",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("first.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))).alias("is_kept"),
    )


def with_components(rows: DataFrame, nodes: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """`rows` (doc_id, text_hash, `key`) with `first`, the first row of their component.

    nodes: `key` and the first row that has it; labels: node, label of those in a component of
    two or more. Neither a component nor a key with very many rows is one task.
    """
    named = stored(nodes.join(labels.withColumnRenamed("node", key), key), "named")
    of_label = named.groupBy("label").agg(F.min("first").alias("first"))
    named = hot_join(named.select(key, "label"), of_label, "label", key).select(key, F.col("first").alias("of_label"))
    every = nodes.join(named, key, "left").select(key, F.coalesce("of_label", "first").alias("first"))
    return hot_join(rows, stored(every, "firsts"), key, "doc_id")


def rows_kept(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of `docs` that `found` (doc_id, text_hash, is_kept) keeps; columns as they came, repeated rows once."""
    found = found.where("is_kept")
    keep = stored(found.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.count("*").alias("__rows")), "kept")
    own_hash, own_id = free_name(docs.columns, "__own_hash"), free_name(docs.columns, "__own_id")
    rows = docs.withColumn(own_hash, F.xxhash64(text_col)).withColumn(own_id, F.col(id_col).cast("long"))
    same = rows[own_id].eqNullSafe(keep["__id"]) & (rows[own_hash] == keep["__hash"])
    rows = rows.join(keep, same, "left_semi")
    if not keep.where("__rows > 1").isEmpty():  # texts are dealt anew only where kept rows repeat
        rows = rows.dropDuplicates([own_id, own_hash])
    return rows.drop(own_id, own_hash)


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """`docs` with one row of each near-duplicate group; columns as they came, repeated rows once."""
    return rows_kept(docs, near_duplicates(docs, id_col, text_col, shingle, distance), id_col, text_col)


def without_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """`docs` with one row of each group of texts whose `shingle`-word shingles are similar to 0.8 or more; see overlap."""
    from quillon.llm import overlap  # builds on this module

    return rows_kept(docs, overlap.near_duplicates(docs, id_col, text_col, shingle), id_col, text_col)
