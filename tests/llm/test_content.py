"""Quality scores, personal data, web archives and the pipeline."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import pii, quality, queries, warc


def test_isotonic():
    x, y = quality.isotonic(np.array([0, 1, 2, 3.0]), np.array([0, 1, 0, 1.0]), np.ones(4))
    assert y.tolist() == [0, 0.5, 1] and x.tolist() == [0, 1.5, 3]


def test_normal_equations_are_sums(spark):
    rows = [([float(i % 7), float(i % 3)], float(i % 2)) for i in range(50)]
    df = spark.createDataFrame(rows, "x array<double>, y double").repartition(5)
    f = quality.Fourier(np.zeros(2), np.ones(2), 8, 1.0, 0)
    a, b = quality.normal_equations(df, f)
    z = f(np.array([r[0] for r in rows]))
    assert np.allclose(a, z.T @ z) and np.allclose(b, z.T @ np.array([r[1] for r in rows]))


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    made = queries.op1_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert (made.predicted == made.quality).mean() > 0.95
    good, bad = made[made.quality == 1].score.values, made[made.quality == 0].score.values
    assert (good[:, None] > bad).mean() > 0.97


def test_scores_of_odd_rows(spark, docs, empty):
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    got = quality.score(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert {r.score for r in quality.score(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score(empty, labels).count() == 0
    # what is held out teaches nothing
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(map(tuple, quality.score(docs, turned).collect())) == sorted(map(tuple, got))


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (13 <= len(digits) <= 19 and pii.luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans():
    import random

    r = random.Random(3)
    pieces = ["a@b.c", "@", ".", "x.y@z", "1.2.3.4", "300.1.2.3", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (375) 555-4393", "+1", " ", "-", "99", "bob%1@mail.example.com", "a@b@c.d", "٣", "@x.y", "é@é.de", "0004.1.1.1"]
    for _ in range(3000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(1, 8)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_field_finds_looser_spellings_and_leaves_numbers_alone():
    field = pii.default_field()
    found = lambda t: [k for k, _, _ in pii.find([t], field)[0][1]]
    assert found("please mail bob [at] example [dot] com now") == ["email"]
    assert found("call (375) 555-4393 today") == ["phone"]
    assert found("card 4111.1111.1111.1111 on file") == ["card"]
    for clean in ("in 1998 there were 12,000 of them", "version 2.4.1 of 2024-01-05", "password=32bb02aa3b580bf8ab here", "the dot at the end", "pages 12-14 and 3.5 percent", ""):
        assert found(clean) == [], clean
    table = pii.labelled_table(150, seed=99)
    right = wanted = 0
    for (_, spans), (_, all_) in zip(table, pii.find([t for t, _ in table], field), strict=True):
        own = [s for s in spans if s[0] != "card"]
        wanted += len(own)
        right += len(set(own) & set(all_))
    assert right > 0.8 * wanted


def test_viterbi_is_the_best_path():
    from itertools import product

    field = pii.default_field()
    shapes = pii.tokenize("a@b . c")[0][:4]
    ids, _ = field.features([shapes])
    e = field.scores(ids)[0]

    def total(path):
        if pii.TAGS[path[0]].startswith("I") or not all(pii._ALLOWED[a, b] for a, b in zip(path, path[1:])):
            return -1e9
        return sum(e[t, p] for t, p in enumerate(path)) + sum(field.move[a, b] for a, b in zip(path, path[1:]))

    best = max(product(range(len(pii.TAGS)), repeat=len(shapes)), key=total)
    assert field.decode([shapes])[0].tolist() == list(best)


def test_report_and_redaction(spark, docs, empty):
    rows = [(1, "Mail a@b.com or +1 (375) 555-4393, a@b.com"), (2, None), (3, "clean"), (3, "clean")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.report(df).collect()}
    assert (got[1].n_email, got[1].n_phone, got[1].n_card, got[2].spans) == (2, 1, 0, "")
    assert got[1].spans.startswith("email:5:12,email:35:42,phone:16:33")
    out = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert out == {1: "Mail [EMAIL] or [PHONE], [EMAIL]", 2: None, 3: "clean"}
    assert pii.redact(docs).columns == docs.columns and pii.report(empty).count() == 0 and pii.redact(empty).count() == 0
    assert pii.report(docs).count() == docs.count()


def test_derivatives(spark, tmp_path):
    html = "<html lang=en><head><title>A  page</title><meta name=author content=X><style>no</style></head><body><p>One &amp; two</p><script>no</script><a href='/x'>link</a></body></html>"
    pages = spark.createDataFrame([(1, "http://a.b/c", html), (2, None, None), (3, "http://a.b/d", "")], "page_id long, url string, html string")
    source = warc.responses(pages)
    made = warc.derive(source).collect()
    by = {(r.target_uri, r.type): r for r in made}
    assert len(made) == 6 and bytes(by["http://a.b/c", "conversion"].block).decode() == "One & two\nlink"
    about = bytes(by["http://a.b/c", "metadata"].block).decode()
    response = source.filter("target_uri = 'http://a.b/c'").first()
    assert "title: A page" in about and "outlink: http://a.b/x" in about and f"source-payload-digest: {response.headers['WARC-Payload-Digest']}" in about and "source-x-page-id: 1" in about
    for kind in ("conversion", "metadata"):
        r = by["http://a.b/c", kind]
        assert r.headers["WARC-Refers-To"] == response.record_id and r.headers["WARC-Block-Digest"] == warc.digest(bytes(r.block))
    # written, read again and derived again, all stays the same
    data = b"".join(bytes(r.value) for r in warc.serialize(source).collect())
    (tmp_path / "a.warc").write_bytes(data)
    again = warc.derive(warc.read(spark, str(tmp_path / "a.warc"))).collect()
    assert sorted((r.record_id, bytes(r.block)) for r in again if r.type == "conversion") == sorted((r.record_id, bytes(r.block)) for r in made if r.type == "conversion")
    assert warc.derive(source.filter("type = 'request'")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as c

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = docs.columns, docs.select("doc_id").toPandas().doc_id
    frames = []
    for name, stage in c.STAGES:
        docs = c.materialize(stage(spark, docs, sf), name.replace(" ", "-"))
        frames.append(docs)
    assert all(f.columns == columns for f in frames[:-1])
    sizes = [f.count() for f in frames[:-1]]
    assert len(ids) > sizes[0] > sizes[1] >= sizes[2] == sizes[3] > 0
    masked = frames[3].toPandas()
    assert not any(pii.base_spans(t) for t in masked.text) and (masked.text.map(len) == masked.n_chars).all()
    packed = frames[4].toPandas()
    assert set(packed.doc_id) == set(masked.doc_id) and packed.groupby("sequence_id").length.sum().max() <= 2048


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_agrees_with_sql(spark, name, duck, sf_dir):
    from helpers import duck_rows, spark_rows

    assert spark_rows(queries.QUERIES[name](spark, sf_dir)) == duck_rows(duck, queries.ORACLES[name])


@given(st.lists(st.sampled_from(["<![foo bar]>", "<!", "<![CDATA[x]]>", "<svg>", "</svg>", "<template>", "<p>", "</p>", "text ", "&amp;", "<script>", "</script>", "<title>", "</title>", "<a href='http://[x'>", "<![if IE]>", "<!DOCTYPE", "<?php", "\0", "<"]), max_size=14))
@settings(max_examples=400, deadline=None)
def test_any_page_can_be_read(parts):
    two = warc.derive_one("id", "http://a/b", "d", {}, b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + "".join(parts).encode())
    assert [r["type"] for r in two] == ["conversion", "metadata"]


@pytest.mark.parametrize("name", ["idna", "undefined", "hex", "mbcs", "rot13", "punycode", "no-such", "utf-7", "latin-1"])
def test_any_charset_can_be_named(name):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=" + name.encode() + b"\r\n\r\n<p>caf\xe9 \xff</p>"
    assert warc.derive_one("id", "u", "d", {}, block)[0]["block"].startswith(b"caf")


def test_codings_are_undone():
    import gzip
    import zlib

    page = b"<p>hello</p><p>world</p>"
    chunked = b"".join(b"%x\r\n%s\r\n" % (len(c), c) for c in (page[:7], page[7:])) + b"0\r\n\r\n"
    bare = zlib.compressobj(wbits=-15)
    bare = bare.compress(page) + bare.flush()
    zipped = gzip.compress(page)
    cases = [("Transfer-Encoding: chunked", chunked), ("Transfer-Encoding: chunked", page), ("Content-Encoding: gzip", zipped), ("Content-Encoding: gzip", page), ("Content-Encoding: deflate", zlib.compress(page)), ("Content-Encoding: deflate", bare)]
    cases.append(("Transfer-Encoding: chunked\r\nContent-Encoding: gzip", b"%x\r\n%s\r\n0\r\n\r\n" % (len(zipped), zipped)))
    for header, payload in cases:
        conversion, _ = warc.derive_one("id", "u", "d", {}, b"HTTP/1.1 200 OK\r\n" + header.encode() + b"\r\n\r\n" + payload)
        assert conversion["block"] == b"hello\nworld", header
    assert warc._inflated(zipped[:-12])  # cut off: as far as it goes


def test_files_that_are_broken():
    import gzip

    def one(k):
        return warc.dump({"type": "response", "record_id": f"r{k}", "target_uri": "u", "date": "d", "headers": [("X", "1")], "block": b"b%d" % k})

    assert [r["block"] for r in warc.parse(one(1) + one(2))] == [b"b1", b"b2"]
    assert [r["block"] for r in warc.parse(gzip.compress(one(1)) + gzip.compress(one(2)))] == [b"b1", b"b2"]
    assert [r["block"] for r in warc.parse((gzip.compress(one(1)) + gzip.compress(one(2)))[:-9])][:1] == [b"b1"]
    assert [r["block"] for r in warc.parse(one(1).replace(b"Content-Length: 2", b"Content-Length: x") + one(2))] == [b"b1", b"b2"]
    assert dict(next(warc.parse(one(1).replace(b"X: 1", b"X: 1\r\nX: 2")))["headers"])["X"] == "1, 2"
    assert warc.dump({"type": "metadata", "record_id": "r", "target_uri": None, "date": None, "headers": None, "block": None}).endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n")
    assert list(warc.parse(b"")) == list(warc.parse(b"WARC/1.1")) == []


def test_an_element_that_never_ends_hides_nothing():
    text = lambda html: warc.plain(warc.read_page(html, "u"))
    assert text("<p>a</p><svg><p>b</p>") == "a\nb"
    assert text("<p>a</p><svg>x</svg><p>b</p>") == "a\nb"
    assert text("<p>a</p><template><svg>x</template><p>b</p>") == "a\nb"
    assert text("<p>a</p><script>code") == "a"


def test_scores_by_a_plain_refit(spark, sf_dir):
    import zlib

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = {r.doc_id: float(r.quality) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    key = {i: zlib.crc32(str(i).encode()) for i in docs}
    x = {i: np.array(quality.statistics(t)) for i, t in docs.items()}
    taught = [i for i in labels if i in docs and key[i] % 3 != 1]
    all_x = np.array([x[i] for i in taught])
    f = quality.Fourier(all_x.mean(axis=0), all_x.std(axis=0), 512, 3.0, 7)
    fit = [i for i in taught if key[i] // 3 % 5]
    z, y = f(np.array([x[i] for i in fit])), np.array([labels[i] for i in fit])
    beta = np.linalg.solve(z.T @ z + 1e-4 * max(1.0, len(fit)) * np.eye(z.shape[1]), z.T @ y)
    raw = {i: float((f(x[i][None]) @ beta)[0]) for i in docs}
    bins = {}
    for i in taught:
        if key[i] // 3 % 5 == 0:
            bins.setdefault(np.floor((min(1.5, max(-0.5, raw[i])) + 0.5) / 2 * 1000), []).append(i)
    pools = [[np.mean([raw[i] for i in b]), np.mean([labels[i] for i in b]), len(b)] for b in bins.values()]
    pools = sorted(pools)
    # the least-squares non-decreasing fit by its definition: the largest of all lower means, of the smallest upper ones
    w, v = np.array([p[2] for p in pools]), np.array([p[1] for p in pools])
    level = [max(min((w[a : b + 1] @ v[a : b + 1]) / w[a : b + 1].sum() for b in range(k, len(v))) for a in range(k + 1)) for k in range(len(v))]
    knots, values = [], []
    for u in dict.fromkeys(np.round(level, 12)):
        own = [k for k in range(len(v)) if round(level[k], 12) == u]
        knots.append(sum(pools[k][0] * pools[k][2] for k in own) / sum(pools[k][2] for k in own))
        values.append(u)
    want = {i: np.interp(r, [knots[0] - 1, *knots, knots[-1] + 1], [0, *values, 1]) for i, r in raw.items()}
    got = {r.doc_id: r.score for r in queries.op1_quality(spark, sf_dir).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in got) < 1e-6


def test_viterbi_of_many_sequences():
    from itertools import product

    field = pii.default_field()
    sequences = [pii.tokenize(t)[0][:4] for t in ("a@b . c", "bob [at] x", "(375) 555", "4111.1111", "in 1998", "x", "+1 (2", "1.2.3.4")] + [[]]
    found = field.decode(sequences, cells=8)
    for shapes, tags in zip(sequences, found, strict=True):
        if not shapes:
            assert len(tags) == 0
            continue
        e = field.scores(field.features([shapes])[0])[0]
        allowed = lambda p: not pii.TAGS[p[0]].startswith("I") and all(pii._ALLOWED[a, b] for a, b in zip(p, p[1:]))
        total = lambda p: sum(e[t, k] for t, k in enumerate(p)) + sum(field.move[a, b] for a, b in zip(p, p[1:]))
        best = max(filter(allowed, product(range(len(pii.TAGS)), repeat=len(shapes))), key=total)
        assert allowed(tags.tolist()) and abs(total(tags.tolist()) - total(best)) < 1e-9


def test_stages_on_odd_rows(spark, docs, empty, sf_dir):
    """Every stage takes nulls, empty and long texts, repeated rows, clashing columns and empty tables."""
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        rows = out.collect()
        assert stage(spark, empty, sf_dir).count() == 0, name
        if name != corpus_pipeline.STAGES[-1][0]:
            # n_chars may join the columns of a table that lacks it
            assert set(docs.columns) <= set(out.columns), name
            assert {r.doc_id for r in rows} <= {r.doc_id for r in docs.collect()}
