"""SimHash near-duplicates at a Jaccard similarity of word shingles.

Two texts with a similarity of 0.8 have fingerprints about 10 bits apart, too far for keys made of
a fingerprint alone: they would meet in a share of all pairs. So sets first meet in a shingle,
then the fingerprints' pigeonring chains prune, and the exact similarity decides.

- Let every set of n shingles be sorted in one order common to all sets. Two sets with a similarity
  of at least t share at least t * max(n) shingles, so the first n - ceil(t * n) + 1 of each must
  have one in common. Any common order is right; shingles found often in a sample come last, which
  keeps the groups that meet small.
- Of two sets that meet, the chains of wider fingerprints of BITS bits over their distinct shingles must stay within
  the budgets of WITHIN bits. A bit differs with a chance of 0.152 at a similarity of 0.8, so a true pair is
  beyond WITHIN with a chance of about 7e-9; of the shortest texts (five shingles against four) 0.188, and 3e-5. At a
  similarity of 0.3 two in a hundred pass.
- In a group every set is first compared with a leader, another one in each group, in some turns. Only
  pairs that those links leave in different components are then compared.
- Groups of more than BLOCK sets, or SHINGLES shingles, are cut into blocks; every two blocks are a unit. A unit names
  its candidate pairs only where they take less room than the sets themselves. Otherwise the sets come to
  the unit, which compares them in place and returns a spanning forest, so no table of pairs grows with the
  square of a group's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_intdigest

from quillon.llm.common import dropped, ship_code, slices, stored
from quillon.llm.graph import components
from quillon.llm.simhash import SEED, Forest, block_pairs, chains_pass, shingle_hashes, with_components

SHINGLE = 5
#: Least similarity of a link, as a fraction.
NUM, DEN = 4, 5
#: Bits of a fingerprint, those that similar sets may differ in, and constants that make its words of 64 bits from one hash.
BITS, WITHIN = 256, 74
_WORDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
WORDS = [f"w{i}" for i in range(BITS // 64)]
#: One text in so many has its shingles counted for the order, and the most shingles that it holds. Results do not depend on them.
SAMPLE, FREQUENT = 8, 200_000
#: Up to so many ids of candidates are broadcast, so that no set moves which nothing is compared with.
IDS = 1_000_000
#: How often each group names a leader before all that are still apart are compared.
TURNS = 1
#: Pairs that are compared in one part, about.
PAIRS = 1000
#: Sets, and shingles of all of them, that one unit of a group may hold. Results do not depend on them.
BLOCK, SHINGLES = 4096, 2_000_000
#: A named pair takes about as much room as so many shingles.
PAIR_ROOM = 3


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles of one UTF-8 text, ascending. Fewer words than that are one shingle, no word none."""
    return np.unique(np.frombuffer(shingle_hashes(text, shingle), np.uint64))


def _set(text: bytes | None, shingle: int) -> tuple[int, np.ndarray]:
    """A set's own number, and its shingles."""
    grams = shingles(text, shingle).view(np.int64)
    return int(np.uint64(xxh64_intdigest(grams.tobytes(), SEED)).view(np.int64)), grams


def _fingerprint(grams: np.ndarray) -> np.ndarray:
    """SimHash of distinct shingles in BITS bits, as signed words."""
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(grams), 1 << 14):
        x = grams[at : at + (1 << 14)].view(np.uint64)[:, None] + _WORDS
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
        total += np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > len(grams)).view(np.int64)


def _numbers(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = [_set(t, shingle) for t in batch.column(2).cast(pa.binary()).to_pylist()]
        fps = np.array([_fingerprint(grams) for _, grams in sets]).reshape(len(sets), len(WORDS))
        columns = [pa.array([s for s, _ in sets], pa.int64()), *map(pa.array, np.ascontiguousarray(fps.T))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "text_hash", "sid", *WORDS])


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        got = [_set(t, shingle) for t in batch.column(0).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int64()), pa.array([x[1].tobytes() for x in got], pa.binary())], ["sid", "grams"])


def _counts(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        got = [_set(t, shingle)[1] for t in batch.column(0).cast(pa.binary()).to_pylist()]
        if got:
            found, n = np.unique(np.concatenate(got), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["gram", "n"])


def _prefixes(batches: Iterator[pa.RecordBatch], shingle: int, frequent: np.ndarray, often: np.ndarray, block: int) -> Iterator[pa.RecordBatch]:
    """(gram, salt, sid, place) of the shingles that a set is looked up by; place is the size of the set and the place in the common order.

    Shingles that the sample holds very often are dealt to several tasks by a salt above 0.
    """
    done: set[int] = set()
    for batch in slices(batches):
        out: list[list[np.ndarray]] = [[], [], [], []]
        for text in batch.column(0).cast(pa.binary()).to_pylist():
            sid, grams = _set(text, shingle)
            n = len(grams)
            if not n or sid in done:
                continue
            done.add(sid)
            size = n - (n * NUM + DEN - 1) // DEN + 1
            rank = np.zeros(n, np.int64)
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)
                rank = np.where(frequent[at] == grams, often[at], 0)
            order = np.lexsort((grams, rank))[:size]
            tasks = rank[order] * SAMPLE // block
            salt = np.where(tasks > 1, 1 + sid % np.maximum(tasks, 1), 0)
            for column, x in zip(out, (grams[order], salt, np.full(size, sid, np.int64), (n << 32) + np.arange(size)), strict=True):
                column.append(x)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["gram", "salt", "sid", "place"])


def _viable(n: np.ndarray, pos: np.ndarray, n2: np.ndarray, pos2: np.ndarray) -> np.ndarray:
    """Can sets whose first common shingle stands at these places still be similar enough?"""
    n, pos, n2, pos2 = (x.astype(np.int64) for x in (n, pos, n2, pos2))
    return np.minimum(n - pos, n2 - pos2) * (NUM + DEN) >= NUM * (n + n2)


def _candidates(n: np.ndarray, pos: np.ndarray, fp: list[np.ndarray], at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Those of `at` that can be similar to their partner in `to`: by size and place, then by chains of fingerprints."""
    ok = np.flatnonzero(_viable(n[at], pos[at], n[to], pos[to]))
    at, to = at[ok], to[ok]
    apart = [(w[at] ^ w[to]).view(np.uint64) for w in fp]
    spent = [np.bitwise_count(half) for x in apart for half in (x >> np.uint64(32), x & np.uint64(0xFFFFFFFF))]
    return at[chains_pass(np.column_stack(spent).astype(np.int64), WITHIN)]


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of batches sorted by the first column, cut between its values only."""
    kept: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        if kept[0][0][0] == kept[-1][0][-1]:
            continue  # the group still goes on
        columns = [np.concatenate(x) for x in zip(*kept)]
        cut = np.flatnonzero(columns[0][1:] != columns[0][:-1])[-1] + 1
        yield [x[:cut] for x in columns]
        kept = [[x[cut:] for x in columns]]
    if kept:
        yield [np.concatenate(x) for x in zip(*kept)]


def _ends(gram: np.ndarray) -> np.ndarray:
    """For each row the end of its group."""
    ends = np.concatenate([np.flatnonzero(gram[1:] != gram[:-1]) + 1, [len(gram)]])
    return np.repeat(ends, np.diff(np.concatenate([[0], ends])))


def _starts(gram: np.ndarray) -> np.ndarray:
    """For each row the start of its group."""
    return np.maximum.accumulate(np.where(np.concatenate([[True], gram[1:] != gram[:-1]]), np.arange(len(gram)), 0))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of two sets or more, without sets that nothing in the group can be similar to by size and place.

    Large groups, and those dealt by a salt, pass as they are.
    """
    for gram, salt, sid, place in _whole_groups(batches):
        new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (salt[1:] != salt[:-1]) | (sid[1:] != sid[:-1])])
        gram, salt, sid, n, pos = gram[new], salt[new], sid[new], place[new] >> 32, place[new] & 0xFFFFFFFF
        end, use = _ends(gram), np.zeros(len(gram), bool)
        large = (end - _starts(gram) > 64) | (salt > 0)
        use[large] = True
        at, step = np.flatnonzero(~large & (np.arange(len(gram)) + 1 < end)), 1
        while len(at):
            ok = at[_viable(n[at], pos[at], n[at + step], pos[at + step])]
            use[ok] = use[ok + step] = True
            step += 1
            at = at[at + step < end[at]]
        if use.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[use]) for x in (gram, sid, n, pos)], ["gram", "sid", "n", "pos"])


def _leaders(batches: Iterator[pa.RecordBatch], turn: int) -> Iterator[pa.RecordBatch]:
    """(unit, a, b): each unit's leader of this turn, another one in each, with those that can be similar to it and are in other components."""
    for unit, sid, n, pos, *fp, label in _whole_groups(batches):
        mixed = (unit.view(np.uint64) ^ (sid.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * _WORDS[turn % len(_WORDS)]
        order = np.lexsort((mixed ^ (mixed >> np.uint64(29)), unit))
        unit, sid, n, pos, label, *fp = (x[order] for x in (unit, sid, n, pos, label, *fp))
        first = _starts(unit)
        follow = np.flatnonzero(label != label[first])
        ok = _candidates(n, pos, fp, follow, first[follow])
        if len(ok):
            x, y = sid[ok], sid[first[ok]]
            yield pa.RecordBatch.from_arrays([pa.array(unit[ok]), pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["unit", "a", "b"])


def _across(batches: Iterator[pa.RecordBatch], room: int) -> Iterator[pa.RecordBatch]:
    """What of a unit can be similar and is not in one component yet: pairs (unit, a, b), or sets (unit, a, label) where pairs take more room."""
    for unit, sid, n, pos, *fp, label in _whole_groups(batches):
        start, end, size = _starts(unit), _ends(unit), np.cumsum(np.concatenate([[0], n]))
        found, mine, named = np.zeros(len(unit), np.int64), np.zeros(len(unit), bool), []  # found: pairs, at the unit's first row
        most = (size[end] - size[start]) // room
        at, step = np.flatnonzero(np.arange(len(unit)) + 1 < end), 1
        while len(at):
            apart = at[label[at] != label[at + step]]
            ok = _candidates(n, pos, fp, apart, apart + step)
            if len(ok):
                mine[ok] = mine[ok + step] = True
                found += np.bincount(start[ok], minlength=len(unit))
                ok = ok[found[start[ok]] <= most[ok]]
                named.append((ok, ok + step))
            step += 1
            at = at[at + step < end[at]]
        dense = found[start] > most
        if named:
            x, y = (np.concatenate(i) for i in zip(*named))
            x, y = x[~dense[x]], y[~dense[x]]
            pairs = [pa.array(unit[x]), pa.array(np.minimum(sid[x], sid[y])), pa.array(np.maximum(sid[x], sid[y])), pa.nulls(len(x), pa.int64())]
            yield pa.RecordBatch.from_arrays(pairs, ["unit", "a", "b", "label"])
        if (whole := np.flatnonzero(dense & mine)).size:
            sets = [pa.array(unit[whole]), pa.array(sid[whole]), pa.nulls(len(whole), pa.int64()), pa.array(label[whole])]
            yield pa.RecordBatch.from_arrays(sets, ["unit", "a", "b", "label"])


def _spanning(sets: pa.Table) -> pa.Table:
    """A spanning forest of the links between the components of one unit's sets (sid, label, grams)."""
    sid, label = sets.column("sid").to_pylist(), sets.column("label").to_pylist()
    own = [np.frombuffer(raw, np.int64) for raw in sets.column("grams").to_pylist()]
    n = np.array([len(x) for x in own])
    number = np.unique(np.concatenate(own), return_inverse=True)[1]
    rows = np.repeat(np.arange(len(own)), n)
    order = np.argsort(number, kind="stable")
    holders, first = rows[order], np.searchsorted(number[order], np.arange(number.max() + 2))
    ends, forest, out = np.cumsum(n), Forest(), []
    for i in range(len(own)):
        mine = number[ends[i] - n[i] : ends[i]]
        length = first[mine + 1] - first[mine]
        at = np.repeat(first[mine] - np.cumsum(length) + length, length) + np.arange(length.sum())
        both = np.bincount(holders[at], minlength=len(own))
        for j in np.flatnonzero(both[:i] * (NUM + DEN) >= NUM * (n[:i] + n[i])).tolist():
            if forest.joins(label[i], label[j]):
                out.append((sid[i], sid[j]))
    return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})


def _similar(pairs: pa.Table, sets: pa.Table) -> pa.Table:
    own = {sid: np.frombuffer(raw, np.int64) for sid, raw in zip(sets.column("sid").to_pylist(), sets.column("grams").to_pylist(), strict=True)}
    good = []
    for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True):
        every = np.sort(np.concatenate([own[a], own[b]]))
        both = int((every[1:] == every[:-1]).sum())
        good.append(both * DEN >= NUM * (len(every) - both))
    return pairs.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _checked(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """Those pairs (a, b, unit) whose sets are similar enough.

    Pairs that met in one unit go to one part, so a set moves once for many of them; units
    with too many pairs for a part are cut into blocks against blocks.
    """
    many = pairs.groupBy("unit").count().where(F.col("count") > PAIRS).select("unit", F.ceil(F.sqrt(F.col("count") / PAIRS)).alias("k"))
    cut = pairs.join(many, "unit", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    block = F.struct("unit", F.pmod(F.xxhash64("a"), F.col("k")), F.pmod(F.xxhash64("b"), F.col("k")))
    parts = max(1, pairs.count() // PAIRS) * 4
    cut = stored(cut.select("a", "b", F.pmod(F.xxhash64(block), F.lit(parts)).alias("part")), "parts")
    ends = cut.select(F.col("part").alias("unit"), F.col("a").alias("sid")).union(cut.select(F.col("part").alias("unit"), F.col("b").alias("sid"))).distinct()
    ends = F.broadcast(ends) if parts * PAIRS <= 4 * IDS else ends
    sets = own.join(ends, "sid").select("unit", "sid", "grams")
    return stored(cut.groupBy("part").cogroup(sets.groupBy("unit")).applyInArrow(_similar, "a long, b long"), "similar")


def _named(buckets: DataFrame, units: Column, labels: DataFrame | None) -> DataFrame:
    """Rows of groups in the units they belong to, with the component of their set, dealt by unit."""
    unit = F.when(F.col("blocks").isNull(), F.col("gram")).otherwise(F.xxhash64("gram", "number")).alias("unit")
    rows = buckets.withColumn("number", F.explode(units))
    label = F.col("sid")
    if labels is not None:
        rows, label = rows.join(labels, rows.sid == labels.node, "left"), F.coalesce("label", "sid")
    rows = rows.select(unit, "sid", "n", "pos", *WORDS, label.alias("label"))
    return rows.repartition("unit").sortWithinPartitions("unit", "sid")


def similar_links(texts: DataFrame, nodes: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(a, b): links that connect the sets of `nodes` exactly as all pairs with a similarity of NUM / DEN or more do.

    texts: doc_id, text_hash, text; nodes: sid, its fingerprint's WORDS and the struct first (doc_id, text_hash) of a row that has this set.
    """
    sample = texts.where(F.pmod(F.xxhash64("text_hash"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(partial(_counts, shingle=shingle), "gram long, n long")
    top = sample.groupBy("gram").agg(F.sum("n").alias("n")).where("n > 2").orderBy(F.desc("n"), "gram").limit(FREQUENT).toPandas().sort_values("gram")
    frequent, often = top.gram.to_numpy(np.int64), top.n.to_numpy(np.int64)
    keys = texts.select("text").mapInArrow(partial(_prefixes, shingle=shingle, frequent=frequent, often=often, block=BLOCK), "gram long, salt long, sid long, place long")
    # Keys are about as large as their texts: parts of half an input part keep what a task holds small.
    parts = max(2 * texts.rdd.getNumPartitions(), int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = keys.repartition(parts, "gram", "salt").sortWithinPartitions("gram", "salt", "sid").mapInArrow(_met, "gram long, sid long, n long, pos long")
    met = stored(met, "met")
    buckets = stored(met.join(nodes.select("sid", *WORDS), "sid").select("gram", "sid", "n", "pos", *WORDS), "buckets")

    seen = nodes.join(buckets.select("sid").distinct(), "sid").select(F.col("first.doc_id").alias("id"), F.col("first.text_hash").alias("hash"))
    same = texts.doc_id.eqNullSafe(F.col("id")) & (texts.text_hash == F.col("hash"))
    ids = stored(seen, "candidates")
    ids = F.broadcast(ids) if ids.count() <= IDS else ids
    own = stored(texts.join(ids, same, "left_semi").select("text").mapInArrow(partial(_sets, shingle=shingle), "sid long, grams binary"), "compared")
    if not own.groupBy("sid").count().where("count > 1").isEmpty():  # sets are dealt anew only where rows repeat
        own = stored(own.dropDuplicates(["sid"]), "compared")

    size = buckets.groupBy("gram").agg(F.greatest(F.count("*") / BLOCK, F.sum("n") / SHINGLES).alias("size"))
    cut = stored(size.where("size > 1").select("gram", F.ceil(2 * F.col("size")).cast("int").alias("blocks")), "cut")
    mine = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")

    links, tried, labels = None, None, None
    for turn in range(TURNS):  # leaders
        pairs = _named(buckets.join(cut, "gram", "left"), F.array(F.coalesce(mine, F.lit(0))), labels).mapInArrow(partial(_leaders, turn=turn), "unit long, a long, b long")
        pairs = pairs.groupBy("a", "b").agg(F.min("unit").alias("unit"))
        pairs = stored(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        found = _checked(pairs, own)
        tried = pairs.select("a", "b") if tried is None else tried.union(pairs.select("a", "b"))
        links = found if links is None else links.union(found)
        labels = stored(components(links, "a", "b"), "labels")
    # Then everyone with everyone that is still in another component.
    every = _named(buckets.join(cut, "gram", "left"), block_pairs(F.col("blocks"), mine), labels)
    met = stored(every.mapInArrow(partial(_across, room=PAIR_ROOM), "unit long, a long, b long, label long"), "across")
    pairs = met.where("b IS NOT NULL").groupBy("a", "b").agg(F.min("unit").alias("unit")).join(tried, ["a", "b"], "left_anti")
    links = links.union(_checked(stored(pairs, "pairs"), own))
    sets = met.where("b IS NULL").select("unit", F.col("a").alias("sid"), "label").join(own, "sid")
    links = links.union(stored(sets.groupBy("unit").applyInArrow(_spanning, "a long, b long"), "spanning"))
    dropped(own)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per row of `docs`: doc_id, text_hash, component_id, is_kept.

    Texts are linked if the Jaccard similarity of their sets of `shingle`-word shingles is at least
    NUM / DEN; component_id is the smallest id reachable over links. ASCII letters count in
    lower case. Texts without a word (null too) link with each other alone; ids, ties and
    repeated rows are treated as in simhash.near_duplicates.
    """
    ship_code(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    sets = stored(own.mapInArrow(partial(_numbers, shingle=shingle), "doc_id long, text_hash long, sid long, " + ", ".join(f"{w} long" for w in WORDS)), "sets")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    nodes = stored(sets.groupBy("sid").agg(first, *[F.min(w).alias(w) for w in WORDS]), "nodes")
    labels = components(similar_links(own, nodes, shingle), "a", "b")
    return with_components(sets.drop(*WORDS), nodes.drop(*WORDS), labels, "sid").select(
        "doc_id",
        "text_hash",
        F.col("first.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))).alias("is_kept"),
    )
