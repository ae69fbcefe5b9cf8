"""Cost-balanced packing of documents into sequences of a fixed number of tokens.

A piece of n tokens costs linear * n + quadratic * n^2, as the layers of a transformer do. Documents are
packed block by block inside each task, in descending order of length, each onto the sequence of lowest cost
so far that still has room. A block has exactly as much room as it has tokens, so a piece that fits nowhere
is cut. Tasks pack on their own, with no shuffle; sequence ids carry the task's partition.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm.encoding import encoded
from tillscope.llm.shared import ship, table, tokenizer_path

#: FLOPs of one layer for n tokens at hidden size 1024: 24 h^2 n + 4 h n^2.
LINEAR, QUADRATIC = 24 * 1024 * 1024, 4 * 1024
PIECE = "doc_id BIGINT, start BIGINT, length BIGINT, ids_crc32 BIGINT, doc_tokens BIGINT, sequence_id BIGINT, offset BIGINT, sequence_length BIGINT"


def cost(n: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> float:
    return linear * n + quadratic * n * n


def sizes(total: int, limit: int) -> list[int]:
    """Sequence lengths that hold exactly `total` tokens: full ones, and powers of two for the rest."""
    rest = total % limit
    return [limit] * (total // limit) + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def balance(lengths: list[int], limit: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; `lengths` are those of the documents."""
    room = sizes(sum(lengths), limit)
    size = list(room)
    pieces = [(-n, i, 0) for i, n in enumerate(lengths) if n]
    heapq.heapify(pieces)
    ready = [(0.0, s) for s in range(len(room))]  # by cost
    parked: list[tuple[int, float, int]] = []  # without room for the present length, by room
    while pieces:
        n, document, start = heapq.heappop(pieces)
        n = -n
        while parked and -parked[0][0] >= n:
            _, spent, s = heapq.heappop(parked)
            heapq.heappush(ready, (spent, s))
        while ready and room[ready[0][1]] < n:
            spent, s = heapq.heappop(ready)
            if room[s]:
                heapq.heappush(parked, (-room[s], spent, s))
        if ready:
            spent, s = heapq.heappop(ready)
        else:  # cut it to the largest room
            _, spent, s = heapq.heappop(parked)
        taken = min(n, room[s])
        yield document, start, taken, s, size[s] - room[s]
        room[s] -= taken
        heapq.heappush(ready, (spent + cost(taken, linear, quadratic), s))
        if taken < n:
            heapq.heappush(pieces, (taken - n, document, start + taken))


def pack(
    docs: DataFrame, path: str, limit: int = 2048, end: int = 1, block_tokens: int = 1 << 22, linear: float = LINEAR, quadratic: float = QUADRATIC
) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most `limit` tokens (a power of two).

    Each document's ids are those of its whole text and the id `end`; null text counts as empty, so it is
    the one id `end`. Whole stretches of `limit` tokens fill a sequence each; the rests are balanced by cost.
    Each id lies in exactly one piece, sequences have no gaps, and the rest of a block goes to sequences
    whose lengths are powers of two, so nothing is padded. Result: doc_id, start (ids of the document before
    the piece), length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length. Rows that repeat an id
    are packed each. No documents give no rows. A task holds `block_tokens` ids and one document at a time.
    """

    def packed(batches):
        first = TaskContext.get().partitionId() << 32
        block: list[tuple[int | None, bytes, int]] = []  # id, the rest of its ids, where the rest starts
        held = 0
        rows: list[tuple] = []

        def flush(first: int) -> int:
            lengths = [len(ids) // 4 for _, ids, _ in block]
            used = sizes(sum(lengths), limit)
            for d, start, n, s, offset in balance(lengths, limit, linear, quadratic):
                doc_id, ids, before = block[d]
                crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + n)])
                rows.append((doc_id, before + start, n, crc, before + len(ids) // 4, first + s, offset, used[s]))
            block.clear()
            return first + len(used)

        def batch():
            columns = list(zip(*rows, strict=True)) or [()] * 8
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [c.split(" ")[0] for c in PIECE.split(", ")])

        for doc_id, ids in encoded(batches, path, end):
            n = len(ids) // 4
            whole = n - n % limit
            view = memoryview(ids)
            for start in range(0, whole, limit):
                rows.append((doc_id, start, limit, zlib.crc32(view[4 * start : 4 * (start + limit)]), n, first, 0, limit))
                first += 1
                if len(rows) >= 50_000:
                    yield batch()
            if n > whole:
                block.append((doc_id, ids[4 * whole :], whole))
                held += n - whole
            if held >= block_tokens:
                first, held = flush(first), 0
            if len(rows) >= 50_000:
                yield batch()
        flush(first)
        yield batch()

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(packed, PIECE)


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of 2048."""
    return pack(table(spark, folder, "documents"), tokenizer_path())
