"""Token-id files of patched frame-of-reference blocks.

A file is a row of records, each followed by a newline byte that is no part of it, so that Spark's
own text sink writes it: through Hadoop's file systems, and committed whole or not at all. The
records, little-endian throughout:

    magic "QPFOR002"
    blocks            u32 values, u32 minimum, u8 width, u32 exceptions, then the values less the
                      minimum packed at `width` bits (low bits of outliers too), exception
                      positions u32, exception values u32 (less the minimum, whole)
    block starts      u64 each
    documents         i64 id, u8 id is null, u64 ids, in file order
    footer            u64 blocks, u64 documents, u64 ids, u64 where the block starts begin, magic

The width is that of a percentile of the block's values, so a few large ids do not widen the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quillon.llm.common import fresh_path, remove, ship_code, slices, stored
from quillon.llm.tokenize import encoder, largest_id

MAGIC = b"QPFOR002"
NEWLINE = b"\n"
BLOCK = 4096
PERCENTILE = 90
END_ID = 2
_HEAD = np.dtype([("values", "<u4"), ("low", "<u4"), ("width", "u1"), ("exceptions", "<u4")])
_DOC = np.dtype([("id", "<i8"), ("none", "u1"), ("n", "<u8")])
_FOOT = np.dtype([("blocks", "<u8"), ("docs", "<u8"), ("ids", "<u8"), ("starts", "<u8"), ("magic", "S8")])


def encode_block(ids: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    """One block; an empty array gives a block of no values."""
    low = int(ids.min()) if len(ids) else 0
    rest = (ids - np.uint32(low)).astype("<u4")
    width = int(np.partition(rest, k := (len(rest) - 1) * percentile // 100)[k]).bit_length() if len(rest) else 0
    over = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    bits = np.unpackbits(rest.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    head = np.array([(len(ids), low, width, len(over))], _HEAD)
    return head.tobytes() + np.packbits(bits, bitorder="little").tobytes() + over.astype("<u4").tobytes() + rest[over].tobytes()


def decode_block(raw: bytes) -> np.ndarray:
    head = np.frombuffer(raw, _HEAD, 1)[0]
    n, width, m = int(head["values"]), int(head["width"]), int(head["exceptions"])
    size = (n * width + 7) // 8
    bits = np.unpackbits(np.frombuffer(raw, np.uint8, size, _HEAD.itemsize), count=n * width, bitorder="little").reshape(n, width)
    whole = np.zeros((n, 32), np.uint8)
    whole[:, :width] = bits
    out = np.packbits(whole, axis=1, bitorder="little").view("<u4").ravel()
    where, values = np.frombuffer(raw, "<u4", 2 * m, _HEAD.itemsize + size).reshape(2, m)
    out[where] = values
    return out + head["low"]


class Writer:
    """Turns documents into the records of one file; holds a block and 17 bytes a document."""

    def __init__(self, block: int = BLOCK, percentile: int = PERCENTILE) -> None:
        self.block, self.percentile = block, percentile
        self.starts: list[int] = []
        self.docs: list[tuple[int, bool, int]] = []
        self.held: list[bytes] = []
        self.size = self.ids = 0
        self.at = len(MAGIC) + len(NEWLINE)

    def _block(self, ids: np.ndarray) -> bytes:
        raw = encode_block(ids, self.percentile)
        self.starts.append(self.at)
        self.at += len(raw) + len(NEWLINE)
        return raw

    def add(self, doc: int | None, raw: bytes) -> Iterator[bytes]:
        """The blocks that a document fills up."""
        if not self.docs:
            yield MAGIC
        self.docs.append((doc or 0, doc is None, len(raw) // 4))
        self.held.append(raw)
        self.size += len(raw) // 4
        self.ids += len(raw) // 4
        if self.size >= self.block:
            ids = np.frombuffer(b"".join(self.held), "<u4")
            cut = len(ids) // self.block * self.block
            for i in range(0, cut, self.block):
                yield self._block(ids[i : i + self.block])
            self.held, self.size = [ids[cut:].tobytes()], len(ids) - cut

    def close(self) -> Iterator[bytes]:
        """The last block, the index and the footer; nothing where there was no document."""
        if not self.docs:
            return
        if self.size:
            yield self._block(np.frombuffer(b"".join(self.held), "<u4"))
        yield np.array(self.starts, "<u8").tobytes()
        yield np.array(self.docs, _DOC).tobytes()
        yield np.array([(len(self.starts), len(self.docs), self.ids, self.at, MAGIC)], _FOOT).tobytes()


class Reader:
    """Random access by block, and the documents of a file in order."""

    def __init__(self, source) -> None:
        self.source = source
        source.seek(0, 2)
        end = source.tell()
        source.seek(end - _FOOT.itemsize - len(NEWLINE))
        foot = np.frombuffer(source.read(_FOOT.itemsize), _FOOT)[0]
        if foot["magic"] != MAGIC:
            raise ValueError("not a token-id file")
        source.seek(int(foot["starts"]))
        self.starts = np.frombuffer(source.read(8 * int(foot["blocks"])), "<u8").astype(np.int64)
        source.seek(len(NEWLINE), 1)
        self.docs = np.frombuffer(source.read(_DOC.itemsize * int(foot["docs"])), _DOC)
        self.ends = np.append(self.starts[1:], int(foot["starts"]))

    def blocks(self, first: int, last: int) -> np.ndarray:
        """Ids of blocks first..last-1."""
        if first >= last:
            return np.empty(0, "<u4")
        self.source.seek(int(self.starts[first]))
        raw, at = self.source.read(int(self.ends[last - 1] - self.starts[first])), int(self.starts[first])
        return np.concatenate([decode_block(raw[a - at : b - at]) for a, b in zip(self.starts[first:last].tolist(), self.ends[first:last].tolist())])

    def documents(self, blocks_at_once: int = 64) -> Iterator[tuple[int | None, int, int]]:
        """(id, ids, crc32 of the ids) of each document."""
        held, at, block = b"", 0, 0
        for doc, none, n in self.docs.tolist():
            crc, need = 0, 4 * n
            while need:
                if at == len(held):
                    held, at = self.blocks(block, min(block + blocks_at_once, len(self.starts))).tobytes(), 0
                    block += blocks_at_once
                got = min(need, len(held) - at)
                crc = crc32(memoryview(held)[at : at + got], crc)
                need, at = need - got, at + got
            yield None if none else doc, n, crc


def _encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int, width: int, bounds: list[int], nameless: int) -> Iterator[pa.RecordBatch]:
    """Ids of each text at `width` bytes, and the number of its file: rows without an id fill the first `nameless`, by text hash."""
    enc, end = encoder(path), np.array([end_id], "<u4").tobytes()
    names = ["file", "doc_id", "text_hash", "ids"]
    for batch in batches:
        ids, none = batch.column(0), batch.column(0).is_null().to_numpy(zero_copy_only=False)
        hashes = batch.column(1).to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
        file = nameless + np.searchsorted(bounds, ids.fill_null(0).to_numpy(), side="left").astype(np.int32)
        file = np.where(none, ((hashes >> np.uint64(32)) * np.uint64(nameless)) >> np.uint64(32), file).astype(np.int32)
        for at, found in enc.groups(batch.column(2)):
            n = len(found)
            raws = [np.frombuffer(raw + end, "<u4").astype(f"<u{width}").tobytes() for raw in found]
            columns = [pa.array(file[at : at + n]), ids[at : at + n], batch.column(1)[at : at + n], pa.array(raws, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)


def _records(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The records of one task's file."""
    writer, held = Writer(), []
    batch_of = lambda raws: pa.RecordBatch.from_arrays([pa.array(raws, pa.binary())], ["value"])
    for batch in slices(batches):
        for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.extend(writer.add(doc, raw if width == 4 else np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()))
            if len(held) >= 256:
                yield batch_of(held)
                held = []
    yield batch_of([*held, *writer.close()])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of whole files: file, doc_id, ids before it in its file, n_tokens, ids_crc32."""
    names = ["file", "doc_id", "start", "n_tokens", "ids_crc32"]
    for batch in batches:
        for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            with pa.BufferReader(content.as_buffer()) as source:
                if not source.size():
                    continue
                docs, n, crc = zip(*Reader(source).documents(), strict=True)
            n = np.array(n, np.int64)
            columns = [pa.array(np.full(len(n), file, np.int32)), pa.array(docs, pa.int64()), pa.array(np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names)


def write_ids(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, files: int | None = None) -> None:
    """Writes token ids of all documents in ascending id order; the order of files is that of their names.

    `folder` is a path of any file system that Spark writes to. Rows without an id come first, in
    files of their own, by a hash of their text, as do rows of one id; a null or empty text is the end id
    alone; whole texts are encoded, however long; repeated rows are written each by itself; an
    empty table writes no document. Other columns are not read.
    """
    spark = docs.sparkSession
    ship_code(spark)
    files = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    id_ = F.col(id_col).cast("long").alias("doc_id")
    # Files are cut at quantiles of the id, a value per file, so that ids move and texts do not.
    steps = [i / files for i in range(1, files)]
    cuts = F.percentile_approx("doc_id", steps, max(10_000, 4 * files)) if steps else F.lit(None)
    found, rows, named = docs.select(id_).agg(cuts, F.count("*"), F.count("doc_id")).first()
    nameless = -(-(rows - named) * files // max(rows, 1))
    bounds = sorted(set(found or []))
    width = 2 if max(largest_id(tokenizer), end_id) < 1 << 16 else 4
    own = docs.select(id_, F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    encoded = own.mapInArrow(
        partial(_encoded, path=tokenizer, end_id=end_id, width=width, bounds=bounds, nameless=nameless), "file int, doc_id long, text_hash long, ids binary"
    )
    dealt = encoded.repartitionById(nameless + len(bounds) + 1, F.col("file")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text_hash").select("doc_id", "ids")
    records = dealt.mapInArrow(partial(_records, width=width), "value binary")
    records.select(F.col("value").cast("string")).write.option("lineSep", NEWLINE.decode()).option("compression", "none").text(folder)


def read_ids(spark, folder: str) -> DataFrame:
    """One row per document from the files: doc_id, start (ids before it), n_tokens, ids_crc32. Files are read once."""
    ship_code(spark)
    whole = spark.read.format("binaryFile").load(folder).where("length > 0")
    whole = whole.select(F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("int").alias("file"), "content")
    # A task reads one file at a time: files count as so large to open that none shares a task.
    was = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", spark.conf.get("spark.sql.files.maxPartitionBytes"))
    try:
        rows = stored(whole.mapInArrow(_read, "file int, doc_id long, start long, n_tokens long, ids_crc32 long"), "token-rows")
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", was)
    # A row for each file: the only ones that one task adds up.
    sums = rows.groupBy("file").agg(F.sum("n_tokens").alias("ids"))
    before = sums.select("file", F.coalesce(F.sum("ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(before), "file").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """write_ids() into a new shared folder, then read_ids() from it; the files go when they are read."""
    spark = docs.sparkSession
    folder = fresh_path(spark, "token-ids")
    write_ids(docs, tokenizer, folder, **options)
    rows = read_ids(spark, folder)
    remove(spark, folder)
    return rows
