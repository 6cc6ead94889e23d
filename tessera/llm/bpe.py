"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into overlapping windows that are pre-tokenised independently (in parallel: long texts become several
rows). Where two neighbouring windows have a pre-token boundary at the same place inside their overlap, both agree from
there on, since the pattern never looks backwards; the windows are stitched at the first such place. The pieces
between the seams are then encoded by rank, and decoding concatenates raw bytes. Seams follow a character that is not white
space, so that no piece depends on what comes after it.

Inside a piece the same fact gives finer chunks: a space after a character that is not white space always begins a
pre-token, so a piece falls apart into chunks that can be encoded once and remembered.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import slices

#: The characters with Unicode's White_Space property, without the space itself.
OTHER_SPACE = "\\t-\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SPACE_AFTER_SPACE = re.compile(f"[ {OTHER_SPACE}] ")
_CHUNK = re.compile(f"[ {OTHER_SPACE}]*[^ {OTHER_SPACE}][^ ]*(?<=[^ {OTHER_SPACE}])|[ {OTHER_SPACE}]+")
_ENDS_IN_SPACE = re.compile(f"[ {OTHER_SPACE}]$")
SLICE_CHARS = 2_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, of a ``.tiktoken`` rank file or of a ``tokenizers`` JSON file whose merges are in id order."""
    if not path.endswith(".json"):
        with open(path, "rb") as lines:
            return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    order = [model["vocab"][a + b] for a, b in merges]
    if order != sorted(order):
        raise ValueError(f"{path}: the merges are not in id order")
    learned = set(order)  # special tokens are in the vocabulary, but no merge makes them
    return {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if len(token) == 1 or i in learned}


def load_added(path: str) -> dict[str, int]:
    """The added tokens of a ``tokenizers`` JSON file: their strings are taken out of a text before all else."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file).get("added_tokens") or []
    for t in found:
        if t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized"):
            raise ValueError(f"{path}: {t['content']!r} has settings that are not supported")
    return {t["content"]: t["id"] for t in found}


#: What an entry of the memory takes besides its characters and ids, about.
_ENTRY = 200


class ChunkEncoder:
    """Encodes texts to little-endian uint32 ids. Remembers chunks in two generations of ``remember`` bytes each.

    With ``added``, the added tokens of a JSON file are found first, the leftmost and of these the longest one, and what is
    between them is encoded as texts of their own.
    """

    def __init__(self, path: str, pattern: str, added: bool = False, remember: int = 24 << 20):
        import tiktoken

        ranks = load_ranks(path)
        self._added = load_added(path) if added else {}
        self._finds = re.compile("|".join(map(re.escape, sorted(self._added, key=len, reverse=True)))) if self._added else None
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.token_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.token_bytes[i] = token
        self._sizes = np.array([len(t) for t in self.token_bytes], dtype=np.int64)
        for text, i in self._added.items():
            self.token_bytes += [b""] * (i + 1 - len(self.token_bytes))
            self.token_bytes[i] = text.encode()
        self._remember, self._held, self._new, self._old = remember, 0, {}, {}

    def encode_many(self, texts: list[str]) -> list[bytes]:
        if self._finds and any(map(self._finds.search, texts)):
            return [self._around(t) for t in texts]
        return self._plain(texts)

    def _plain(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for a, b in slices(texts, map(len, texts), SLICE_CHARS):
            split = [self._chunks(t) for t in texts[a:b]]
            self._learn(set().union(*split))
            get = self._new.__getitem__
            out += [b"".join(map(get, chunks)) for chunks in split]
        return out

    def _around(self, text: str) -> bytes:
        found = [(m.start(), m.end()) for m in self._finds.finditer(text)]
        edges = [0, *(x for pair in found for x in pair), len(text)]
        gaps = self._plain([text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])
        own = [np.array([self._added[text[a:b]]], "<u4").tobytes() for a, b in found] + [b""]
        return b"".join(x for pair in zip(gaps, own, strict=True) for x in pair)

    def decode(self, ids: bytes) -> bytes:
        table = self.token_bytes
        return b"".join([table[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])

    @staticmethod
    def _chunks(text: str) -> list[str]:
        if "\0" in text or _SPACE_AFTER_SPACE.search(text):
            return _CHUNK.findall(text)
        return text.replace(" ", "\0 ").split("\0")

    def _ids(self, text: str) -> np.ndarray:
        return np.asarray(self.encoding.encode_to_numpy(text, disallowed_special=()), dtype="<u4")

    def _learn(self, chunks: set[str]) -> None:
        need = chunks - self._new.keys()
        if self._held > self._remember:
            self._old, self._new, self._held, need = self._new, {}, 0, chunks
        new, old = self._new, self._old
        self._held += sum(map(len, need)) * 2 + _ENTRY * len(need)
        joined: list[str] = []
        for chunk in need:
            if (ids := old.get(chunk)) is not None:
                new[chunk] = ids
            elif chunk[:1] == " " and not _ENDS_IN_SPACE.search(chunk):
                joined.append(chunk)  # begins at a safe boundary and leaves one behind
            else:
                new[chunk] = self._ids(chunk).tobytes()
        if joined:
            ids = self._ids("".join(joined))
            ends = np.cumsum(self._sizes[ids])
            cuts = np.searchsorted(ends, np.cumsum([len(c.encode()) for c in joined]), side="left") + 1
            raw, at = ids.tobytes(), 0
            for chunk, end in zip(joined, (cuts * 4).tolist(), strict=True):
                new[chunk], at = raw[at:end], end


_ENCODERS: dict[tuple[str, str, bool], ChunkEncoder] = {}


def encoder(path: str, pattern: str, added: bool = False) -> ChunkEncoder:
    """One encoder for each Python worker, the last that was asked for: its memory of chunks lasts from task to task."""
    key = path, pattern, added
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = ChunkEncoder(*key)
    return _ENCODERS[key]


def pretokens(pattern, text: str) -> list[int]:
    """Starts of the pre-tokens of ``text``."""
    return [m.start() for m in pattern.finditer(text)]


def cut(text: str, window: int, overlap: int):
    """(offset, window) of ``text``: every window but the first begins ``overlap`` characters before its neighbour's end."""
    for at in range(0, max(1, len(text) - overlap), window - overlap):
        yield at, text[at : at + window]


def stitch(windows, pattern):
    """Successive pieces of a text, from its windows (offset, text, starts) in order of offset.

    Two windows meet at the first boundary that both have inside their overlap and that follows no white space. Without one
    (a pre-token longer than the overlap), the left one's last pre-token and the right window are read as one.
    """
    held = None
    for offset, text, starts in windows:
        if held is None:
            held = (offset, text, starts)
            continue
        at, left, left_starts = held
        ends = at + len(left)
        own = {offset + s for s in starts}
        meet = next((at + s for s in left_starts[bisect_left(left_starts, max(1, offset - at)) :] if at + s in own and at + s < ends and not left[s - 1].isspace()), None)
        if meet is None:
            last = next((s for s in reversed(left_starts) if s and not left[s - 1].isspace()), 0)
            if last:
                yield left[:last]
            merged = left[last:] + text[ends - offset :]
            held = (at + last, merged, pretokens(pattern, merged))
        else:
            yield left[: meet - at]
            held = (meet, text[meet - offset :], [s + offset - meet for s in starts if s + offset >= meet])
    if held is not None and held[1]:
        yield held[1]


ENCODED = "doc_id long, ids binary"


def encode(docs: DataFrame, path: str, pattern: str, window: int = 4_096, overlap: int = 256, spread: int = 1 << 20, emit=None, schema: str = ENCODED) -> DataFrame:
    """Token ids of every whole text of ``docs`` (doc_id, text; other columns are ignored).

    ``emit(doc_ids, ids, encoder)`` makes the returned columns from a batch; by default doc_id and the ids as bytes
    (little-endian uint32). Texts of more than ``window`` characters become overlapping windows, which are pre-tokenised
    each by itself and stitched; the pieces are encoded. For texts of up to ``spread`` characters that happens where they are
    read, many texts at a time. Of longer ones, stretches of ``spread`` characters (which overlap like windows) are spread
    over the cluster, pre-tokenised there, stitched in order, and their pieces spread again to be encoded. Null texts count
    as empty, empty texts have no ids, ids that repeat are encoded row by row (a long text whose doc_id repeats is kept
    apart by a row number).
    """
    emit = emit or (lambda ids, found, _: [ids, found])
    names = [f.split()[0] for f in schema.split(",")]
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    length = F.length("text")

    def pieces(text: str, compiled) -> list[str]:
        if len(text) <= window:
            return [text]
        return list(stitch(((at, t, pretokens(compiled, t)) for at, t in cut(text, window, overlap)), compiled))

    def encoded(texts: list[str], coder, compiled) -> list[bytes]:
        split = [pieces(t, compiled) for t in texts]
        ids = iter(coder.encode_many([p for own in split for p in own]))
        return [b"".join(next(ids) for _ in own) for own in split]

    def short(batches):
        import regex

        compiled, coder = regex.compile(pattern), encoder(path, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts, map(len, texts), SLICE_CHARS):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in emit(batch.column(0)[a:b].to_pylist(), encoded(texts[a:b], coder, compiled), coder)], names=names)

    def stretches(batches):
        for batch in batches:
            for doc, row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for at, part in cut(text, spread, overlap):
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((doc, row, at, part), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "row", "place", "text"])

    def scan(batches):
        import regex

        compiled = regex.compile(pattern)
        for batch in batches:
            starts = []
            for text in batch.column(3).to_pylist():
                # the windows of a stretch give its boundaries; a piece's own are those of the whole
                found, at = [], 0
                for piece in pieces(text, compiled):
                    found += [at + s for s in pretokens(compiled, piece)]
                    at += len(piece)
                starts.append(np.array(found, dtype="<i4").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts, pa.binary())], names=["doc_id", "row", "place", "text", "starts"])

    def join(batches):
        from itertools import groupby

        import regex

        compiled = regex.compile(pattern)

        def windows():
            for batch in batches:
                for doc, row, at, text, starts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield (doc, row), (at, text, np.frombuffer(starts, dtype="<i4").tolist())

        for (doc, row), group in groupby(windows(), key=lambda x: x[0]):
            for k, piece in enumerate(stitch((w for _, w in group), compiled)):
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((doc, row, k, piece), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "row", "place", "text"])

    def code(batches):
        import regex

        compiled, coder = regex.compile(pattern), encoder(path, pattern)
        for batch in batches:
            ids = encoded(batch.column(3).to_pylist(), coder, compiled)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.binary())], names=["doc_id", "row", "place", "ids"])

    def whole(batches):
        from itertools import groupby

        coder = encoder(path, pattern)
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for (doc, _), group in groupby(rows, key=lambda r: r[:2]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in emit([doc], [b"".join(r[3] for r in group)], coder)], names=names)

    part = "doc_id long, row long, place long, "
    long = docs.filter(length > spread).select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    scanned = long.mapInArrow(stretches, part + "text string").repartition("row", "place").mapInArrow(scan, part + "text string, starts binary")
    joined = scanned.repartition("row").sortWithinPartitions("row", "place").mapInArrow(join, part + "text string")
    coded = joined.repartition("row", "place").mapInArrow(code, part + "ids binary")
    done = coded.repartition("row").sortWithinPartitions("row", "place").mapInArrow(whole, schema)
    return docs.filter(length <= spread).mapInArrow(short, schema).unionByName(done)


def digest(ids: list[int], found: list[bytes], coder: ChunkEncoder) -> list[list]:
    """doc_id, n_tokens, SHA-256 of the ids, SHA-256 of the decoded bytes."""
    return [ids, [len(x) // 4 for x in found], [hashlib.sha256(x).hexdigest() for x in found], [hashlib.sha256(coder.decode(x)).hexdigest() for x in found]]


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Raw bytes (doc_id, data) of encoded documents (doc_id, ids); null ids give no bytes."""

    def run(batches):
        coder = encoder(path, pattern)
        for batch in batches:
            data = [coder.decode(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")
