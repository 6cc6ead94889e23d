"""Set-similarity join of documents over word n-grams: a grouped prefix join.

Documents with equal sets are one class. Within a global order that puts rare n-grams first, two sets that link must share
an n-gram early in both: a class is listed under the n-grams of its prefix only. Classes with the same prefix and size form
one group, expanded to its members in the lists; there, each meets the heaviest one, then only those of other components.
Pairs are filtered by size and by the places of the n-gram they share, and verified on the whole sets.

The order only decides how many candidates there are, never the result, so a sketch of fixed size (counts by hash, over all
documents) is enough to tell common n-grams from rare ones.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import materialize, maybe_broadcast, slices
from .links import linked

_MIX = np.uint64(0x9E3779B97F4A7C15)
CELL_BITS = 22
SLICE_CHARS = 500_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_random = np.random.default_rng(20)
#: A random 64-bit value for each byte; A-Z have those of a-z.
_BYTES = _random.integers(0, 1 << 64, 256, dtype=np.uint64)
_BYTES[65:91] = _BYTES[97:123]
_BASE = int(_random.integers(0, 1 << 63)) * 2 + 1
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64)] * 2  # of the base, and of its inverse modulo 2**64


def _power(size: int) -> list[np.ndarray]:
    if len(_powers[0]) < size:
        size = max(size, 1 << 20)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def shingles(texts: list[str], n: int) -> list[np.ndarray]:
    """Of every text: sorted distinct 64-bit hashes of its word n-grams; with fewer words, of the whole sequence; none without.

    Words are runs without ASCII white space, A-Z lower-cased. All words of all texts are hashed at once, as differences of
    one running polynomial over the bytes.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    begin = np.cumsum([0, *(len(r) + 1 for r in raw)])[:-1]
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    edges = edges if space[0] else np.concatenate([[0], edges])
    starts, ends = edges[::2], edges[1::2]
    up, down = _power(len(data))
    running = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=running[1:])
    words = _mix((running[ends] - running[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MIX)
    of = np.searchsorted(begin, starts, side="right") - 1
    counts = np.bincount(of, minlength=len(texts))
    total = words[: max(0, len(words) - n + 1)].copy()
    for k in range(1, n):
        total = _mix(total * _MIX + words[k : len(total) + k])
    total = _mix(total + np.uint64(n))
    first = np.cumsum(counts) - counts
    out = []
    for at, m in zip(first.tolist(), counts.tolist(), strict=True):
        if m >= n:
            out.append(np.unique(total[at : at + m - n + 1]))
        elif not m:
            out.append(np.zeros(0, dtype=np.uint64))
        else:
            whole = words[at : at + 1].copy()
            for k in range(1, m):
                whole = _mix(whole * _MIX + words[at + k : at + k + 1])
            out.append(_mix(whole + np.uint64(m)))
    return out


def sketch(docs: DataFrame, n: int, chunks: int = 16) -> np.ndarray:
    """How many n-grams of all documents fall into each of 2**CELL_BITS cells; summed by chunks on the executors."""

    def count(batches):
        import zstandard

        cells = np.zeros(1 << CELL_BITS, dtype="<u4")
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in slices(texts, map(len, texts), SLICE_CHARS):
                np.add.at(cells, np.concatenate(shingles(texts[a:b], n)) >> np.uint64(64 - CELL_BITS), 1)
        for k, part in enumerate(np.split(cells, chunks)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zstandard.ZstdCompressor(level=1).compress(part.tobytes())], pa.binary())], names=["chunk", "cells"])

    def add(table: pa.Table) -> pa.Table:
        import zstandard

        total = sum(np.frombuffer(zstandard.ZstdDecompressor().decompress(c.as_py()), dtype="<u4").astype(np.uint64) for c in table.column("cells"))
        return pa.table({"chunk": table.column("chunk")[:1], "cells": pa.array([zstandard.ZstdCompressor(level=1).compress(np.minimum(total, 2**32 - 1).astype("<u4").tobytes())], pa.binary())})

    import zstandard

    size = (1 << CELL_BITS) // chunks
    out = np.zeros(1 << CELL_BITS, dtype="<u4")
    for r in docs.select(F.coalesce("text", F.lit(""))).mapInArrow(count, "chunk int, cells binary").groupBy("chunk").applyInArrow(add, "chunk int, cells binary").collect():
        out[r["chunk"] * size : (r["chunk"] + 1) * size] = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["cells"]), dtype="<u4")
    return out


def levels(cells: np.ndarray) -> np.ndarray:
    """0 for cells of up to twice the mean, then one more for every doubling: common n-grams come last in the order."""
    usual = max(1.0, 2 * cells.mean())
    return np.ceil(np.log2(np.maximum(cells / usual, 1))).astype(np.uint8)


BASE = "doc_id long, row long, n_shingles long, id long, prefix array<long>"


def prefixes(docs: DataFrame, n: int, percent: int, level: np.ndarray) -> DataFrame:
    """Of every document: the size of its set, a hash of it (``id`` names its class), and the prefix in the order.

    ``row`` is a hash of the text: it tells rows with the same doc_id apart.
    """
    held = docs.sparkSession.sparkContext.broadcast(level)  # one byte for each cell: 4 MB, whatever the corpus holds

    def run(batches):
        level = held.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in slices(texts, map(len, texts), SLICE_CHARS):
                sizes, ids, prefix = [], [], []
                for s in shingles(texts[a:b], n):
                    m = len(s)
                    sizes.append(m)
                    ids.append(_signed(s.sum(dtype=np.uint64)))
                    own = level[s >> np.uint64(64 - CELL_BITS)]
                    prefix.append(s[np.argsort(own, kind="stable")][: m - ceil(percent * m / 100) + 1 if m else 0].view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(prefix, pa.list_(pa.int64()))], names=[f.split()[0] for f in BASE.split(", ")])

    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("row"), text.alias("text")).mapInArrow(run, BASE)


def _signed(x) -> int:
    x = int(x)
    return x - (1 << 64) if x >> 63 else x


def sets(docs: DataFrame, n: int) -> DataFrame:
    """id (as in prefixes) and the whole set of every document."""

    def run(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in slices(texts, map(len, texts), SLICE_CHARS):
                found = shingles(texts[a:b], n)
                yield pa.RecordBatch.from_arrays([pa.array([_signed(s.sum(dtype=np.uint64)) for s in found], pa.int64()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], names=["id", "s"])

    return docs.select(F.coalesce("text", F.lit(""))).mapInArrow(run, "id long, s array<long>")


def classes(docs: DataFrame, n: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame]:
    """(base, component): prefixes() of every document, and (id, component, component_id) of every class with words."""
    base = materialize(prefixes(docs, n, percent, levels(sketch(docs, n))), "prefixes")
    full = base.filter("n_shingles > 0")
    distinct = materialize(full.groupBy("id", "n_shingles").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.min("prefix").alias("prefix")), "classes")
    # one group for each prefix and size; "members" are listed under their group's own key, so that they meet as well
    grouped = materialize(distinct.withColumn("group", F.xxhash64("prefix", "n_shingles")), "grouped")
    groups = grouped.groupBy("group").agg(F.first("n_shingles").alias("size"), F.first("prefix").alias("prefix"), F.count(F.lit(1)).alias("members"))
    tokens = groups.select("group", "size", "members", F.posexplode("prefix").alias("pos", "token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.max("members").alias("m")).filter("n > 1 OR m > 1").select("token")
    listed = tokens.join(shared, "token").select("token", "group", "pos")
    lists = listed.join(grouped, "group").select(F.col("token").alias("key"), "id", "pos", F.col("n_shingles").alias("size"), (F.col("copies") * 4096 - F.col("pos")).alias("weight"))
    lists = materialize(lists, "lists")

    def admissible(a: str, b: str):
        # 100 * common >= percent * union  <=>  common >= percent * (|a| + |b|) / (100 + percent)
        least = F.ceil(percent * (F.col(f"{a}.size") + F.col(f"{b}.size")) / F.lit(100 + percent))
        fits = 100 * F.least(f"{a}.size", f"{b}.size") >= percent * F.greatest(f"{a}.size", f"{b}.size")
        return fits & (F.col(f"{a}.size") - F.col(f"{a}.pos") >= least) & (F.col(f"{b}.size") - F.col(f"{b}.pos") >= least)

    def verify(met: DataFrame) -> DataFrame:
        met = materialize(met, "pairs")
        # common n-grams up to the end of the prefix that ends first are in both prefixes; of the rest of that set, all may be
        # common: that rules most pairs out by their prefixes alone
        short = distinct.select("id", "prefix", "n_shingles")
        both = met.join(short.select(F.col("id").alias("a"), F.col("prefix").alias("p"), F.col("n_shingles").alias("m")), "a").join(short.select(F.col("id").alias("b"), F.col("prefix").alias("q"), F.col("n_shingles").alias("n")), "b")
        beyond = F.greatest(F.col("m") - F.size("p"), F.col("n") - F.size("q"))
        least = F.ceil(percent * (F.col("m") + F.col("n")) / F.lit(100 + percent))
        near = materialize(both.filter(F.size(F.array_intersect("p", "q")) + beyond >= least).select("a", "b"), "near-pairs")
        ids = near.select(F.col("a").alias("id")).unionByName(near.select(F.col("b").alias("id"))).distinct()
        wanted = materialize(distinct.join(ids, "id").select("doc_id", "id"), "wanted")
        few = maybe_broadcast(wanted.select("doc_id").distinct(), wanted.count(), 32)
        read = sets(docs.join(few, docs.doc_id.eqNullSafe(few.doc_id), "left_semi"), n)
        read = materialize(read.join(wanted.select("id"), "id", "left_semi").dropDuplicates(["id"]), "sets")
        both = near.join(read.select(F.col("id").alias("a"), F.col("s").alias("x")), "a").join(read.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))
        return both.filter(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")

    component = linked(lists, admissible, verify, "ngrams")
    labelled = distinct.join(materialize(component, "ngram-components"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    smallest = labelled.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return base, labelled.join(smallest, "component").select("id", "component", "component_id")


def join(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach, itself included) of every document.

    Two documents link when 100 * |common n-grams| >= ``percent`` * |all their n-grams|. Null and empty texts, and those
    without words, have empty sets and link with nothing. Repeated rows are returned each, and a null doc_id is never the
    smallest (its component is null where no other id is in it). N-grams and sets are told apart by 64-bit hashes. Other
    columns are ignored; an empty table gives no rows.
    """
    base, component = classes(docs, n, percent)
    out = base.join(component, (base.id == component.id) & (base.n_shingles > 0), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def dedup(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of linked ones: the first by doc_id (a null id after all others) and text.

    Links are those of join(). Documents without words stay, as does every document that links with none; of rows that
    repeat a doc_id and its text one stays. All columns stay.
    """
    base, component = classes(docs, n, percent)
    known = base.join(component, (base.id == component.id) & (base.n_shingles > 0), "left")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    kept = known.filter("n_shingles > 0").groupBy("component").agg(F.min(place).alias("p")).select("p.doc_id", "p.row")
    keep = kept.unionByName(base.filter("n_shingles = 0").select("doc_id", "row")).distinct().withColumnsRenamed({"doc_id": "doc_id__", "row": "row__"})
    text = F.coalesce("text", F.lit(""))
    out = docs.join(keep, docs.doc_id.eqNullSafe(F.col("doc_id__")) & (F.xxhash64(text) == F.col("row__")), "left_semi")
    repeated = base.groupBy("doc_id", "row").count().filter("count > 1").limit(1).count()
    return out.withColumn("row__", F.xxhash64(text)).dropDuplicates(["doc_id", "row__"]).drop("row__") if repeated else out
