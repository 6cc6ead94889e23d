"""Best-fit decreasing packing of tokenised documents into sequences of fixed length.

Documents of equal length are interchangeable, so the plan is made over the histogram of lengths: at most ``capacity``
numbers reach the driver, whatever the corpus holds. The plan is the one that best-fit decreasing makes document by
document: a segment tree over remaining capacities gives the tightest open bin in logarithmic time, and all documents of a
length that would take the same kind of bin are placed at once. Every document then finds its place by its rank among
those of its length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import materialize, slices
from .bpe import SLICE_CHARS, encoder


class CapacityTree:
    """How many open bins have each remaining capacity; the least capacity in use that is at least a given one."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += n
            node >>= 1

    def tightest(self, least: int) -> int | None:
        node = least + self.leaves
        if self.count[node]:
            return least
        while node > 1:
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, how many, first bin, offset) that place every document; ranks count within a length.

    The number of rows depends on the lengths in use (``capacity`` at most), not on the number of documents: a step empties
    a run of bins or ends a length, and makes two runs at most.
    """
    tree, runs, rows, bins = CapacityTree(capacity), {}, [], 0
    for length in sorted((n for n in histogram if histogram[n]), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not in 1..{capacity}")
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, (first, n) = capacity, (bins, -(-left // (capacity // length)))
                bins += n
            else:
                first, n = runs[room].pop()
                tree.add(room, -n)
            # the tightest bin stays the tightest until it is full, so it takes as many as fit
            each = room // length
            full = min(n, left // each)
            if full:
                for slot in range(each):
                    rows.append((length, rank, full, first, capacity - room + slot * length))
                    rank += full
                left -= full * each
                _put(tree, runs, room - each * length, first, full)
            if full < n and left and left < each:
                for slot in range(left):
                    rows.append((length, rank, 1, first + full, capacity - room + slot * length))
                    rank += 1
                _put(tree, runs, room - left * length, first + full, 1)
                full, left = full + 1, 0
            if full < n:
                _put(tree, runs, room, first + full, n - full)
    return np.array(rows, dtype=np.int64).reshape(-1, 5)


def _put(tree: CapacityTree, runs: dict[int, list], room: int, first: int, n: int) -> None:
    if room:
        runs.setdefault(room, []).append((first, n))
        tree.add(room, n)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def pieces(docs: DataFrame, path: str, pattern: str, capacity: int, end_id: int) -> DataFrame:
    """One row for each piece of each text: cut points, checksum, and its rank among pieces of its length in its partition."""

    def run(batches):
        from pyspark import TaskContext

        coder, part = encoder(path, pattern, path.endswith(".json")), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts, map(len, texts), SLICE_CHARS):
                out: list[tuple] = []
                for doc, ids in zip(batch.column(0)[a:b].to_pylist(), coder.encode_many(texts[a:b]), strict=True):
                    ids += end
                    n = len(ids) // 4
                    first = (n - 1) % capacity + 1
                    for k, stop in enumerate(range(first, n + 1, capacity)):
                        start = max(0, stop - capacity)
                        seen[stop - start] += 1
                        out.append((doc, k, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop]), part, int(seen[stop - start]) - 1))
                columns = zip(*out, strict=True)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in PIECES.split(", ")])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, path: str, pattern: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Packs every document (doc_id, text; other columns are ignored) into sequences of at most ``capacity`` tokens.

    A document is its ids and ``end_id``; the added tokens of a JSON file are found in texts, as the library finds them. One longer than ``capacity`` is cut, its first piece taking what is left over.
    Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset. A null text counts as empty and takes one
    token; repeated rows are packed each; a null doc_id stays null; an empty table gives no rows.
    """
    # ranks count within partitions, so the rows must not be made twice: a retry could see them in another order
    made = materialize(pieces(docs, path, pattern, capacity, end_id), "pieces")
    counts = made.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = plan(histogram, capacity)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    keys = rows[:, 0] << 44 | rows[:, 1]

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            at = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            sequence = rows[at, 3] + rank - rows[at, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(rows[at, 4])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    placed = made.join(base, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))
    return placed.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
