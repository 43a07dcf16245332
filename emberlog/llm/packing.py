"""Packing of tokenised documents into fixed-size sequences by Karmarkar-Karp multiway differencing.

Documents are tokenised once, in the task that reads them, and packed there, so nothing is shuffled. Whole
multiples of the sequence size leave a document as full sequences. The remainders gather in cells of
CELL_WINDOWS windows, as pieces of at most GRAIN tokens. A cell is divided by multiway differencing: every piece
starts as a partition with one loaded window, and the two partitions of the largest spread are merged with their
loads in opposite order until one is left. Where a window is beyond the capacity, the cell is divided again into
one window more. A cell closes SLACK tokens a window before its windows are full, which is about what the
windows of such pieces differ by, so that the count seldom rises. Neighbouring pieces of a document that meet in
a window are one piece again. A cell is bounded by parameters, never by the input.

A sequence id is the task's number times 2**33 plus a running number, so ids are unique and the same on a
second attempt.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shrink_executors, small_batches, tidy
from .tokens import Encoder

SEQUENCE = 2048
CELL_WINDOWS = 96
GRAIN, SLACK = 256, 12
END_ID = 1
#: Rows of an Arrow batch.
BATCH = 500
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Indices of `sizes` in `windows` groups of near-equal sums (largest differencing method)."""
    groups = [[] for _ in range(windows)]
    if not sizes:
        return groups
    heap = []
    for i, size in enumerate(sizes):
        heap.append((-size, i, {0: (size, [i])}))  # window -> (load over the lightest, members); absent: (0, none)
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # loads of a from the largest down meet those of b from the smallest up
        down = sorted(a.values(), key=lambda x: -x[0])
        up = sorted(b.values(), key=lambda x: -x[0])
        merged = []
        for j, (load, members) in enumerate(down):
            k = windows - 1 - j
            if k < len(up):
                merged.append((load + up[k][0], members + up[k][1]))
            else:
                merged.append((load, members))
        for j, (load, members) in enumerate(up):
            if windows - 1 - j >= len(down):
                merged.append((load, members))
        low = min(x[0] for x in merged) if len(merged) == windows else 0
        out = {j: (load - low, members) for j, (load, members) in enumerate(merged) if load > low or members}
        heapq.heappush(heap, (-max((x[0] for x in merged)) + low, tie, out))
        tie += 1
    for j, (_, members) in enumerate(heap[0][2].values()):
        groups[j] = members
    return groups


def divide(sizes: list[int], capacity: int, grain: int = GRAIN) -> list[list[tuple[int, int, int]]]:
    """Windows of (index, start, length), none over the capacity, of near-equal loads.

    The window count begins with the least that the total needs and rises by one as long as differencing loads a
    window beyond the capacity.
    """
    grains = [(i, start, min(grain, size - start)) for i, size in enumerate(sizes) for start in range(0, size, grain)]
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        groups = differencing([g[2] for g in grains], windows)
        if all(sum(grains[g][2] for g in group) <= capacity for group in groups):
            break
        windows += 1
    out = []
    for group in groups:
        parts: list[tuple[int, int, int]] = []
        for i, start, length in sorted(grains[g] for g in group):
            if parts and parts[-1][0] == i and parts[-1][1] + parts[-1][2] == start:
                parts[-1] = (i, parts[-1][1], parts[-1][2] + length)
            else:
                parts.append((i, start, length))
        if parts:
            out.append(parts)
    return out


def _pack(batches: Iterator[pa.RecordBatch], tokenizer: str, sequence: int, cell: int) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(tokenizer)
    number = TaskContext.get().partitionId() << 33
    rows: list[tuple] = []
    held: list[tuple] = []  # doc_id, start, ids, doc_tokens
    load = 0
    room = (sequence - min(SLACK, sequence // 2)) * cell
    schema = pa.schema([pa.field(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])

    def piece(doc_id, start, ids, total, seq, offset):
        rows.append((doc_id, start, len(ids), zlib.crc32(ids), total, seq, offset))

    def close():
        nonlocal number
        for group in divide([len(x[2]) for x in held], sequence):
            at = 0
            for i, start, length in group:
                doc_id, first, ids, total = held[i]
                piece(doc_id, first + start, ids[start : start + length], total, number, at)
                at += length
            number += 1
        held.clear()

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)
        rows.clear()
        return out

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = np.array([*encoder(text.as_py() or ""), END_ID], dtype="<u4")
            total = len(ids)
            full = total - total % sequence
            for start in range(0, full, sequence):
                piece(doc_id, start, ids[start : start + sequence], total, number, 0)
                number += 1
            start = full
            while start < total:  # the cell's last piece is cut where the cell is full
                take = min(total - start, room - load)
                held.append((doc_id, start, ids[start : start + take], total))
                start, load = start + take, load + take
                if load >= room:
                    close()
                    load = 0
        if len(rows) > 20_000:
            yield flush()
    close()
    if rows:
        yield flush()


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, cell: int = CELL_WINDOWS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer: path of the tokenizer file on every machine. A document's ids are those of its text followed
    by END_ID; a null or empty text is the end id alone. Each id lies in exactly one piece, pieces of a
    sequence follow one another without gaps from offset 0, and no sequence exceeds `sequence`. Repeated rows
    and null ids are packed as rows of their own. An empty table gives no piece. Other columns are not read.
    """
    def task(batches):
        yield from tidy(_pack(batches, tokenizer, sequence, cell))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shrink_executors(docs.sparkSession)
    with small_batches(docs.sparkSession, BATCH):  # the pieces are numbers, a small part of the texts: they are written here
        return materialize(rows.mapInArrow(task, SCHEMA), "pieces")
