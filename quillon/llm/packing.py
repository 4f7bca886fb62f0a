"""Packing documents into fixed-length sequences by minimum bin slack.

Only the histogram of piece lengths reaches the driver: at most `capacity` rows, however many
documents there are. Bin by bin, a bitset subset-sum over the lengths still available finds the
fullest feasible filling that holds the longest one left; the filling is then repeated as often
as the counts allow and removed. Pieces learn their place from their rank among equal lengths.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from quillon.llm.common import ship_code, stored
from quillon.llm.tokenize import encoder

CAPACITY = 4096
END_ID = 1


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    """Cuts texts into pieces; `nth` counts pieces of one length within this task."""
    enc, part, seen = encoder(path), TaskContext.get().partitionId(), defaultdict(int)
    end = np.array([end_id], "<u4").tobytes()
    for batch in batches:
        ids = batch.column(0).to_pylist()
        rows: list[tuple] = []
        for at, found in enc.groups(batch.column(1)):
            for doc, raw in zip(ids[at : at + len(found)], found, strict=True):
                raw += end
                for piece, start in enumerate(range(0, len(raw), 4 * capacity)):
                    cut = raw[start : start + 4 * capacity]
                    n = len(cut) // 4
                    rows.append((doc, piece, start // 4, n, crc32(cut), part, seen[n]))
                    seen[n] += 1
        if rows:
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])


def fullest(counts: dict[int, int], lengths: list[int], capacity: int) -> dict[int, int]:
    """The filling of one bin: length -> copies, holding lengths[0], with the least slack.

    `lengths` is descending; `counts` has what is left of each. Bit s of `reach` says that some
    choice of the lengths looked at so far sums to s.
    """
    room = capacity - lengths[0]
    mask, reach = (1 << room + 1) - 1, 1
    steps: list[tuple[int, int]] = []
    for n in lengths:
        left = counts[n] - (n == lengths[0])
        for _ in range(min(left, room // n)):
            grown = (reach | reach << n) & mask
            if grown == reach:
                break
            steps.append((n, reach))
            reach = grown
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, defaultdict(int, {lengths[0]: 1})
    for n, before in reversed(steps):
        if not before >> total & 1:
            out[n] += 1
            total -= n
    return dict(out)


def fillings(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(repeats, filling) until every piece of the histogram has a bin. Each entry uses up a length."""
    counts, out = dict(histogram), []
    lengths = sorted((n for n, c in counts.items() if c), reverse=True)
    while lengths:
        filling = fullest(counts, lengths, capacity)
        times = min(counts[n] // k for n, k in filling.items())
        out.append((times, filling))
        for n, k in filling.items():
            counts[n] -= times * k
        lengths = [n for n in lengths if counts[n]]
    return out


def _segments(plan: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows of (length, first rank, copies a bin, first bin, offset in the bin), sorted."""
    rows, used, bins = [], defaultdict(int), 0
    for times, filling in plan:
        offset = 0
        for n, k in filling.items():
            rows.append((n, used[n], k, bins, offset))
            used[n] += times * k
            offset += n * k
        bins += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _placed(batches: Iterator[pa.RecordBatch], segments: np.ndarray) -> Iterator[pa.RecordBatch]:
    keys = segments[:, 0] << 40 | segments[:, 1]
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    for batch in batches:
        if not batch.num_rows:
            continue
        n, rank = (batch.column(i).to_numpy() for i in (3, 5))
        _, first, copies, bins, offset = segments[np.searchsorted(keys, n << 40 | rank, side="right") - 1].T
        sequence, place = bins + (rank - first) // copies, offset + (rank - first) % copies * n
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(place)], [*names, "sequence_id", "offset"])


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and `end_id`; only longer ones than `capacity` are cut. A null
    or empty text is the end id alone; a null id stays null; repeated rows are packed each by
    itself; an empty table gives no rows; other columns are not read. Sequence ids run from 0
    without gaps and offsets within a sequence are gapless.
    """
    spark = docs.sparkSession
    ship_code(spark)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
    pieces = stored(own.mapInArrow(partial(_pieces, path=tokenizer, end_id=end_id, capacity=capacity), schema), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    segments = _segments(fillings(histogram, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    ranked = pieces.join(counts.select("length", "part", before.alias("before")), ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("before")).alias("rank"))
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(partial(_placed, segments=segments), out)
