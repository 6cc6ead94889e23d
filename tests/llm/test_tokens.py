"""BPE, packing and language-model scores against plain versions."""

import functools
import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import bpe, lm, packing

MULTI, JSON, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(MULTI), special_tokens={})


@given(st.lists(st.text(alphabet=st.sampled_from(list("ab C.,'s19\n\t \x1c\x85 é漢\0")), max_size=40), max_size=4))
@settings(max_examples=300, deadline=None)
def test_chunks_encode_like_the_library(reference_texts):
    coder = bpe.encoder(MULTI, PATTERN)
    for text, ids in zip(reference_texts, coder.encode_many(reference_texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == coder.encoding.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()


@given(st.text(alphabet=st.sampled_from(list("ab C.,'s1\n  é")), max_size=120), st.integers(6, 20), st.integers(1, 5))
@settings(max_examples=300, deadline=None)
def test_windows_meet_at_true_boundaries(text, window, overlap):
    compiled = regex.compile(PATTERN)
    windows = [(at, t, bpe.pretokens(compiled, t)) for at, t in bpe.cut(text, window, overlap)]
    at, found = 0, []
    for piece in bpe.stitch(iter(windows), compiled):
        found += [at + s for s in bpe.pretokens(compiled, piece)]
        at += len(piece)
    assert at == len(text) and found == bpe.pretokens(compiled, text)


@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext|", "a", " b", "\n", "  ", "<|", "|>", "é"]), max_size=12))
@settings(max_examples=300, deadline=None)
def test_added_tokens_as_the_library(parts):
    text = "".join(parts)
    coder = bpe.encoder(JSON, PATTERN, True)
    found = np.frombuffer(coder.encode_many([text, "plain"])[0], "<u4").tolist()
    assert found == _library().encode(text, add_special_tokens=False).ids
    assert coder.decode(np.array(found, "<u4").tobytes()) == text.encode()


@functools.cache
def _library():
    return Tokenizer.from_file(JSON)


@pytest.mark.parametrize("window,overlap,spread", [(4096, 256, 1 << 20), (100, 7, 1 << 20), (100, 7, 900)])
def test_encode(spark, docs, texts, reference, window, overlap, spread):
    rows = bpe.encode(docs, MULTI, PATTERN, window, overlap, spread, bpe.digest, bpe.DIGEST).collect()
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = np.array(reference.encode_ordinary(r.text or ""), "<u4").tobytes()
        want.append((r.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, rows)) == sorted(want)


def test_encode_decode_round_trip(docs, empty):
    coded = bpe.encode(docs, MULTI, PATTERN)
    back = sorted((r.doc_id, bytes(r.data).decode()) for r in bpe.decode(coded, MULTI, PATTERN).collect())
    assert back == sorted((r.doc_id, r.text or "") for r in docs.collect())
    assert bpe.encode(empty, MULTI, PATTERN).count() == 0


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
@settings(max_examples=200, deadline=None)
def test_plan_is_best_fit_decreasing(histogram):
    capacity = 40
    rows = packing.plan(histogram, capacity)
    # document by document, with the tightest open bin for each
    bins = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fit = [b for b in bins if b >= length]
            if fit:
                bins.remove(min(fit))
                bins.append(min(fit) - length)
            else:
                bins.append(capacity - length)
    used = Counter()
    ranks = {}
    for length, rank, n, first, offset in rows.tolist():
        ranks.setdefault(length, []).extend(range(rank, rank + n))
        for b in range(first, first + n):
            assert offset == used[b]
            used[b] += length
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in histogram.items()}
    assert sorted(capacity - u for u in used.values()) == sorted(bins)


def test_pack(docs, empty):
    capacity = 64
    rows = packing.pack(docs, JSON, PATTERN, capacity).collect()
    library = Tokenizer.from_file(JSON)
    whole = Counter()
    for r in docs.collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        first = (len(ids) - 1) % capacity + 1
        for k, stop in enumerate(range(first, len(ids) + 1, capacity)):
            start = max(0, stop - capacity)
            whole[r.doc_id, k, start, stop - start, zlib.crc32(ids[start:stop].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == whole
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    assert packing.pack(empty, JSON, PATTERN, capacity).count() == 0


def plain_scores(docs, corpus, order, alpha):
    split = lambda t: (t or "").lower().split()
    counts = [Counter(tuple(w[i : i + n]) for w in map(split, corpus) for i in range(len(w) - n + 1)) for n in range(1, order + 1)]
    total = sum(counts[0].values())
    out = []
    for w in map(split, docs):
        score = 0.0
        for i in range(len(w)):
            steps = 0
            for n in range(min(order, i + 1), 0, -1):
                gram = tuple(w[i - n + 1 : i + 1])
                below = total if n == 1 else counts[n - 2][gram[:-1]]
                if counts[n - 1][gram]:
                    score += math.log(alpha**steps * counts[n - 1][gram] / below)
                    break
                steps += n > 1
            else:
                score += steps * math.log(alpha) - math.log(total + 1)
        out.append((len(w), round(score, 6)))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores(docs, empty, order):
    rows = docs.collect()
    own = lm.score(docs, order=order, part_chars=2000).collect()
    assert sorted((r.n_words, round(r.log_score, 6)) for r in own) == sorted(plain_scores([r.text for r in rows], [r.text for r in rows], order, 0.4))
    half = docs.filter("doc_id < 100")
    held = lm.score(docs, half, order=order, part_chars=2000).collect()
    assert sorted((r.n_words, round(r.log_score, 6)) for r in held) == sorted(plain_scores([r.text for r in rows], [r.text for r in half.collect()], order, 0.4))
    assert lm.score(empty).count() == 0


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_by_all_other_rows(docs, order):
    texts = [r.text for r in docs.collect()]
    got = lm.score(docs, order=order, leave_out=True, part_chars=2000).collect()
    want = [plain_scores([t], texts[:i] + texts[i + 1 :], order, 0.4)[0] for i, t in enumerate(texts)]
    assert sorted((r.n_words, round(r.log_score, 6)) for r in got) == sorted(want)


def test_registered_scores(spark, duck, sf_dir):
    from tessera.llm import queries

    got = sorted((r.doc_id, r.n_words, r.log_score) for r in queries.QUERIES["op10_lm"](spark, sf_dir).collect())
    want = sorted(duck.execute(queries.ORACLES["op10_lm"]).fetchall())
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=0.002)
