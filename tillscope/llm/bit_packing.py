"""Token ids in fixed-width bit packing.

A token file is a folder of Parquet files whose rows are blocks: some consecutive documents of one shard,
their ids in the minimum number of bits that the vocabulary needs, and offsets. Ids of a block are read at
any position by numpy, without those before it; blocks and shards are found by their offsets. Spark writes
and commits the files, so they may lie in any store.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillscope.llm.encoding import encoded, encoder
from tillscope.llm.shared import scratch, ship, table, tokenizer_path

BLOCK = "shard INT, block INT, first BIGINT, n_ids BIGINT, width INT, doc_ids ARRAY<BIGINT>, lengths ARRAY<BIGINT>, payload BINARY"
FIELDS = pa.schema(
    [("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32()),
     ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())]
)
#: Ids whose bits are spread out at a time.
STEP = 1 << 16


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold ids from 0 to vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """The low `width` bits of each id, lowest first, one id after the other."""
    if width in (8, 16, 32):  # whole bytes
        return ids.astype(f"<u{width // 8}").tobytes()
    parts = []
    for start in range(0, len(ids), STEP):  # STEP ids end on a byte
        part = ids[start : start + STEP].astype("<u4", copy=False)
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
        parts.append(np.packbits(bits, bitorder="little").tobytes())
    return b"".join(parts)


def unpack_bits(payload: bytes, width: int, start: int, count: int) -> np.ndarray:
    """Ids `start` to `start + count` of a payload."""
    if not count:
        return np.empty(0, "<u4")
    at = np.arange(start, start + count, dtype=np.int64) * width
    low, last = int(at[0] >> 3), int((at[-1] + width + 7) >> 3)
    data = np.zeros(last - low + 8, np.uint8)
    data[: last - low] = np.frombuffer(payload, np.uint8, last - low, low)
    place = (at >> 3) - low
    value = np.zeros(count, np.uint64)
    for k in range((width + 14) // 8):
        value |= data[place + k].astype(np.uint64) << np.uint64(8 * k)
    return ((value >> (at & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype("<u4")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = 2, block_ids: int = STEP) -> None:
    """Encode all documents and write them to the folder `path` in ascending doc_id order.

    Each document is the ids of its whole text and the id `end`; null text counts as empty. Shards are
    ranges of doc_id in ascending order; a null id comes first, and rows that repeat an id follow each other
    by a hash of their text. A block holds whole documents, `block_ids` ids or one longer document.
    Only doc_id and text are read, so further columns of any name do no harm; texts may be of any length.
    """

    def blocks(batches):
        shard, width = TaskContext.get().partitionId(), bits_for(encoder(tokenizer).vocabulary)
        block, first, held, doc_ids, parts = 0, 0, 0, [], []

        def row():
            ids = np.frombuffer(b"".join(parts), "<u4")
            lengths = [len(p) // 4 for p in parts]
            return pa.RecordBatch.from_pylist(
                [{"shard": shard, "block": block, "first": first, "n_ids": held, "width": width,
                  "doc_ids": doc_ids, "lengths": lengths, "payload": pack_bits(ids, width)}], FIELDS
            )

        for doc_id, ids in encoded(batches, tokenizer, end):
            if parts and held + len(ids) // 4 > block_ids:
                yield row()
                block, first, held, doc_ids, parts = block + 1, first + held, 0, [], []
            doc_ids.append(doc_id)
            parts.append(ids)
            held += len(ids) // 4
        if parts:
            yield row()

    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    order = ["doc_id", F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # Bits are the compression; a block is then read at any place without inflating it.
    ordered.mapInArrow(blocks, BLOCK).write.option("compression", "uncompressed").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a token folder, with `start`: ids of all documents before the block."""
    blocks = spark.read.schema(BLOCK).parquet(path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return blocks.join(shards, "shard").withColumn("start", F.col("base") + F.col("first")).drop("base")


def token_range(spark: SparkSession, path: str, start: int, count: int) -> list[int]:
    """Ids `start` to `start + count` of the whole folder; reads only the blocks that hold them."""
    held = read_tokens(spark, path).where((F.col("start") < start + count) & (F.col("start") + F.col("n_ids") > start)).orderBy("start")
    found = []
    for b in held.select("start", "n_ids", "width", "payload").toLocalIterator():
        low, high = max(start, b.start), min(start + count, b.start + b.n_ids)
        found += unpack_bits(bytes(b.payload), b.width, low - b.start, high - low).tolist()
    return found


def documents_of(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from blocks."""

    def decoded(batches):
        for batch in batches:
            for place in range(len(batch)):  # one payload at a time
                row = {name: batch.column(name)[place].as_py() for name in batch.schema.names}
                ids = unpack_bits(row["payload"], row["width"], 0, row["n_ids"]).tobytes()
                ends = np.cumsum(row["lengths"], dtype=np.int64)
                starts = ends - np.array(row["lengths"], np.int64)
                crcs = [zlib.crc32(memoryview(ids)[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["start"]), pa.array(row["lengths"], pa.int64()), pa.array(crcs, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    ship(blocks.sparkSession)
    rows = blocks.select("start", "n_ids", "width", "doc_ids", "lengths", "payload")
    return rows.mapInArrow(decoded, "doc_id BIGINT, start BIGINT, n_tokens BIGINT, ids_crc32 BIGINT")


def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """All documents written to token files and read back."""
    path = scratch(spark, "tokens")
    write_tokens(table(spark, folder, "documents"), path, tokenizer_path())
    return documents_of(read_tokens(spark, path))
