"""Language-model scores by stupid backoff, computed relationally.

The n-gram count tables are partitioned by hash and joined to the n-grams of the documents. To keep the rows few, the
relation is carried in columns: a part is a batch of documents, and sends each partition of the count tables its distinct
n-grams as one sorted array with their counts. The partition adds the arrays of all parts up (that is its share of the
count tables) and answers every part with the totals in the order of its array; the part joins them to its n-grams and sums
the scores of each document. What moves follows the distinct n-grams of the parts, never their number of occurrences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import materialize

PART = "part long, n_words long, counted boolean, scored boolean, payload binary"
ASKED = "bucket int, part long, counted boolean, scored boolean, grams binary, counts binary"
ANSWER = "part long, bucket int, counts binary"
SCORES = "doc_id long, n_words long, log_score double"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    """Lower-cased words between white space."""
    return text.lower().split()


class _Hashes(dict):
    """64-bit hash of a word, remembered by the worker."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 300_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_HASHES = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(texts: list[str], order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Number of words of each text, and for n = 1..order the hash of the n-gram that ends at each word (0: there is none)."""
    split = [words(t) for t in texts]
    sizes = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
    get = _HASHES.__getitem__
    flat = np.fromiter((get(w) for s in split for w in s), dtype=np.uint64, count=int(sizes.sum()))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    one = _mix(flat)
    out = [one | np.uint64(1)]
    last = one
    for n in range(2, order + 1):
        longer = np.zeros_like(one)
        longer[1:] = _mix(last[:-1] * _MIX + one[1:] + np.uint64(n))
        last = longer
        out.append(np.where(place >= n - 1, longer | np.uint64(1), np.uint64(0)))
    return sizes, out


def _squeeze(a: np.ndarray) -> bytes:
    """Compresses integers byte plane by byte plane."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()) if len(a) else b""


def _spread(data: bytes, kind) -> np.ndarray:
    import zstandard

    if not data:
        return np.zeros(0, dtype=kind)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(width, -1).T).view(kind).ravel()


def parts(docs: DataFrame, counted: bool, scored: bool, chars: int) -> DataFrame:
    """The documents in compressed batches of about ``chars`` characters, each with a number of its own."""

    def run(batches):
        import pickle

        import zstandard
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32 | int(scored and not counted) << 62
        ids, texts, size = [], [], 0

        def put():
            payload = zstandard.ZstdCompressor(level=3).compress(pickle.dumps((ids, texts)))
            n = sum(len(words(t)) for t in texts)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((number, n, counted, scored, payload), (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()), strict=True)], names=[f.split()[0] for f in PART.split(", ")])

        for batch in batches:
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids.append(doc)
                texts.append(text)
                size += len(text)
                if size >= chars:
                    yield put()
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield put()

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, PART)


def _open(payload: bytes, order: int):
    import pickle

    import zstandard

    ids, texts = pickle.loads(zstandard.ZstdDecompressor().decompress(payload))
    return ids, *grams(texts, order)


def score(docs: DataFrame, corpus: DataFrame | None = None, order: int = 2, backoff: float = 0.4, leave_out: bool = False, part_chars: int = 4_000_000, bucket_words: int = 1_000_000) -> DataFrame:
    """Stupid-backoff scores of every whole text of ``docs`` by the counts of every text of ``corpus`` (``docs`` by default).

    A word's score is count(n-gram) / count(its context) for the longest n <= ``order`` whose n-gram has a count, times
    ``backoff`` for each step down; a word that the corpus lacks gets backoff**steps / (words of the corpus + 1). With
    ``leave_out`` (and no other ``corpus``), every row is scored by the counts of all other rows. Returns n_words and log_score, the sum of natural logarithms over the document (0 without words). N-grams are kept by a 64-bit hash. Null texts count as empty; repeated rows are counted and scored each; other columns are ignored; empty
    tables give no rows, and with an empty corpus every word is one that it lacks.
    """
    if leave_out and corpus is not None:
        raise ValueError("only a row of the corpus itself can be left out of it")
    made = parts(docs, corpus is None, True, part_chars)
    if corpus is not None:
        made = made.unionByName(parts(corpus, True, False, part_chars))
    made = materialize(made, "parts")
    total = made.filter("counted").agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n")).first()["n"]
    all_words = made.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n")).first()["n"]
    bits = max(4, (int(all_words) * order // bucket_words).bit_length())

    def ask(batches):
        for batch in batches:
            for part, _, counted, scored, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = np.concatenate(_open(payload, order)[2])
                distinct, counts = np.unique(found[found > 0], return_counts=True)
                cuts = np.searchsorted(distinct, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist() + [len(distinct)]
                rows = [(b, distinct[a:z], counts[a:z]) for b, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)) if z > a]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b for b, _, _ in rows], pa.int32()),
                        pa.array([part] * len(rows), pa.int64()),
                        pa.array([counted] * len(rows), pa.bool_()),
                        pa.array([scored] * len(rows), pa.bool_()),
                        pa.array([_squeeze(np.diff(g, prepend=np.uint64(0))) for _, g, _ in rows], pa.binary()),
                        pa.array([_squeeze(c.astype("<u4")) for _, _, c in rows], pa.binary()),
                    ],
                    names=[f.split()[0] for f in ASKED.split(", ")],
                )

    def add(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = [np.cumsum(_spread(r["grams"], np.uint64), dtype=np.uint64) for r in rows]
        counts = np.concatenate([_spread(r["counts"], "<u4").astype(np.int64) * r["counted"] for r in rows])
        _, place = np.unique(np.concatenate(own), return_inverse=True)
        totals = np.zeros(place.max(initial=-1) + 1, dtype=np.int64)
        np.add.at(totals, place, counts)
        answer, at = totals[place], 0
        out = []
        for r, g in zip(rows, own, strict=True):
            if r["scored"]:
                out.append((r["part"], r["bucket"], _squeeze(answer[at : at + len(g)])))
            at += len(g)
        return pa.table([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=["part", "bucket", "counts"])

    answers = made.mapInArrow(ask, ASKED).groupBy("bucket").applyInArrow(add, ANSWER)

    def sums(one: pa.Table, many: pa.Table) -> pa.Table:
        # the part of this key, and all answers to it
        out = []
        for payload in one.column("payload").to_pylist():
            ids, sizes, by_order = _open(payload, order)
            found = np.concatenate(by_order)
            distinct = np.unique(found[found > 0])
            rows = sorted(zip(many.column("bucket").to_pylist(), many.column("counts").to_pylist(), strict=True))
            counts = np.concatenate([np.zeros(0, dtype=np.int64), *(_spread(c, np.int64) for _, c in rows)])
            if len(counts) != len(distinct):
                raise ValueError("the answers do not cover the part")
            value = np.zeros(len(by_order[0]))
            missing = np.ones(len(value), dtype=bool)
            row = np.repeat(np.arange(len(sizes)), sizes)

            def of(g: np.ndarray) -> np.ndarray:
                if not len(counts):
                    return np.zeros(len(g), dtype=np.int64)
                at = np.searchsorted(distinct, g).clip(0, len(distinct) - 1)
                all_ = counts[at]
                if leave_out:
                    known = row * (len(distinct) + 1) + np.where(g > 0, at, len(distinct))
                    _, place, own = np.unique(known, return_inverse=True, return_counts=True)
                    all_ = all_ - own[place]
                return np.where(g > 0, all_, 0)

            have = [of(g) for g in by_order]
            words_ = np.full(len(value), total) - (np.repeat(sizes, sizes) if leave_out else 0)
            steps = np.zeros(len(value))
            for n in range(order, 0, -1):
                usable = by_order[n - 1] > 0
                context = np.concatenate([[1], have[n - 2][:-1]]) if n > 1 and len(value) else np.maximum(1, words_)
                hit = missing & usable & (have[n - 1] > 0) & (context > 0)
                value[hit] = np.log(have[n - 1][hit] / context[hit]) + steps[hit] * np.log(backoff)
                missing &= ~hit
                steps += usable & missing & (n > 1)
            value[missing] = steps[missing] * np.log(backoff) - np.log(words_[missing] + 1)
            stop = np.cumsum(sizes)
            exact = [float(value[a:b].sum()) for a, b in zip((stop - sizes).tolist(), stop.tolist(), strict=True)]
            out.append((ids, sizes.tolist(), exact))
        ids, sizes, values = ([x for o in out for x in o[i]] for i in range(3))
        return pa.table([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(values, pa.float64())], names=["doc_id", "n_words", "log_score"])

    # only scored parts are answered; a part without words has no answers and scores 0
    return made.filter("scored").groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(sums, SCORES)
