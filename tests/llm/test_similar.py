"""Near duplicates, fingerprints and search against brute force."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import line_dedup, links, ngram_join, spotsigs, topk


def closure(nodes, edges):
    least = {n: n for n in nodes}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        least[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_connected(spark):
    edges = [(1, 2), (2, 3), (9, 3), (5, 6), (7, 7), (20, 21), (21, 22), (22, 23), (23, 24), (24, 25)]
    got = {r.id: r.component for r in links.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in closure({x for e in edges for x in e}, edges).items() if k != 7}
    assert links.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_sets(rows, n):
    out = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate({i: i + 32 for i in range(65, 91)}))
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    return out


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80), (1, 50)])
def test_ngram_join(docs, empty, n, percent):
    rows = docs.collect()
    sets = shingle_sets(rows, n)
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    groups = closure(range(len(rows)), edges)
    least = {}
    for i, g in groups.items():
        least[g] = min(least.get(g, rows[i].doc_id), rows[i].doc_id)
    want = sorted((r.doc_id, len(sets[i]), least[groups[i]]) for i, r in enumerate(rows))
    assert sorted(map(tuple, ngram_join.join(docs, n, percent).collect())) == want
    kept = ngram_join.dedup(docs, n, percent)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(groups[i] for i in groups if sets[i])) + len({(r.doc_id, r.text or "") for i, r in enumerate(rows) if not sets[i]})
    assert ngram_join.join(empty).count() == 0 and ngram_join.dedup(empty).count() == 0


def test_ngram_join_of_many_near_copies(spark):
    base = [f"w{i}" for i in range(100)]
    rows = [(k, " ".join(f"x{k}" if i in (k % 97, (k * 7) % 89) and k % 3 else w for i, w in enumerate(base))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    class R:
        def __init__(self, t):
            self.text = t

    sets = shingle_sets([R(t) for _, t in rows], 3)
    edges = [(i, j) for i in range(60) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])]
    want = closure(range(60), edges)
    assert {r.doc_id: r.component_id for r in ngram_join.join(docs).collect()} == want


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def near(x, y):
    """The definition of near lines, of normalised ones."""
    longer = lambda a, b: int(0.2 * max(len(a), len(b)) + 1e-9)
    if max(len(x), len(y)) > 30:
        v, w = x.split(" "), y.split(" ")
        edits = distance(v, w)
        if edits <= longer(v, w):
            return True
        if edits > longer(v, w) + line_dedup.SLACK:
            return False
    return distance(x, y) <= longer(x, y)


def occurrences(rows):
    """(doc_id, text, line number, normalised line), of distinct (doc_id, text)."""
    out = []
    for i, text in sorted({(r.doc_id, r.text or "") for r in rows}):
        for k, line in enumerate(text.lower().split("\n")):
            if line := re.sub(r"[\W_]+", " ", line).strip():
                out.append((i, text, k, line))
    return out


def test_line_dedup(docs, empty):
    rows = docs.collect()
    found = occurrences(rows)
    distinct = sorted({o[3] for o in found})
    edges = [(i, j) for i, x in enumerate(distinct) for j in range(i) if near(x, distinct[j])]
    assert edges, "the fixture holds near lines"
    groups = closure(range(len(distinct)), edges)
    by_group = {}
    for o in found:
        by_group.setdefault(groups[distinct.index(o[3])], []).append(o)
    want = sorted((o[0], o[2], own[0][0], own[0][2]) for own in by_group.values() for o in own[1:])
    decided = line_dedup.decisions(docs.dropDuplicates(["doc_id", "text"])).collect()
    got = sorted((r.doc_id, *x) for r in decided for x in zip(r.dropped or [], r.kept_doc_ids or [], r.kept_line_nos or [], strict=True))
    assert len(decided) == len({(r.doc_id, r.text) for r in rows}) and got == want
    assert all(r.n_dropped == len(r.dropped or []) for r in decided)
    out = line_dedup.dedup(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    left = [line for r in out.dropDuplicates(["doc_id", "text"]).collect() for line in (r.text or "").split("\n") if re.search(r"[^\W_]", line)]
    assert len(left) == len(found) - len(want)
    assert {r.text for r in out.collect() if r.text is None or not r.text} >= {None, ""}
    assert line_dedup.dedup(docs, drop_emptied=True).count() < docs.count()
    assert line_dedup.dedup(empty).count() == 0 and line_dedup.decisions(empty).count() == 0


def test_line_dedup_against_pure_edit_similarity(spark, duck, sf_dir):
    """Recall of the lines that plain edit similarity of characters groups, over all pairs of lines of up to 300 characters."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = [o for o in occurrences(docs.select("doc_id", "text").collect()) if len(o[3]) <= 300]
    distinct = sorted({o[3] for o in found})
    duck.execute("CREATE OR REPLACE TEMP TABLE lines_ AS SELECT unnest(?) AS i, unnest(?) AS x", [list(range(len(distinct))), distinct])
    edges = duck.execute("SELECT a.i, b.i FROM lines_ a JOIN lines_ b ON a.i < b.i AND 5 * least(length(a.x), length(b.x)) >= 4 * greatest(length(a.x), length(b.x)) WHERE levenshtein(a.x, b.x) <= floor(0.2 * greatest(length(a.x), length(b.x)) + 1e-9)").fetchall()
    groups = closure(range(len(distinct)), edges)
    at = {x: i for i, x in enumerate(distinct)}
    firsts, want = set(), set()
    for i, _, k, line in found:
        group = groups[at[line]]
        (want.add((i, k)) if group in firsts else firsts.add(group))
    got = {(r.doc_id, k) for r in line_dedup.decisions(docs).collect() for k in r.dropped or []}
    print(f"recall {len(want & got)}/{len(want)}, {len(got)} dropped in all")
    assert len(want) > 100 and len(want & got) >= 0.99 * len(want)


def test_line_dedup_finds_all_near_lines(spark):
    import random

    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    rows = []
    for k in range(120):
        line = [word() for _ in range((5, 8, 10, 20)[k % 4])]
        other = list(line)
        for i in r.sample(range(len(line)), len(line) // 5):
            other[i] = word()
        rows += [(2 * k, " ".join(line)), (2 * k + 1, " ".join(other))]
    decided = line_dedup.decisions(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in decided if r.n_dropped) == list(range(1, 240, 2))


def test_line_dedup_compares_characters_without_punctuation(spark):
    import random

    r = random.Random(11)
    pairs = [("and!! ornd.", "and ornd."), ("eding in.", "eding enin."), ("Prologue", "prologve")]
    for n in (5, 6, 9, 14, 22, 29, 60, 90):
        for _ in range(12):
            line = "".join(r.choice("abcdefghijklmnop") if i % 6 < 5 else " " for i in range(n)).strip()
            other = list(line)
            # anywhere in a short line, in at most a fifth of the words and two more of a longer one
            for i in r.sample(range(len(line)), len(line) // 5) if n < 30 else (2, 14, 26, 27):
                other[i] = "z"
            pairs.append((line, "".join(other)))
    rows = [(2 * k + i, line) for k, two in enumerate(pairs) for i, line in enumerate(two)]
    plain = [re.sub(r"[^a-z]+", " ", line.lower()).strip() for _, line in rows]
    alike = lambda x, y: distance(x, y) <= int(0.2 * max(len(x), len(y)) + 1e-9)
    groups = closure(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if alike(plain[i], plain[j])])
    decided = {r.doc_id: r for r in line_dedup.decisions(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: decided[i].kept_doc_ids[0] if decided[i].n_dropped else i for i in decided} == groups


def test_word_classes_count_all_lines(spark):
    lines = spark.createDataFrame([(8 * k + 1, f"common w{k}") for k in range(64)], "id long, line string")
    assert max(line_dedup.word_classes(lines)) >= 24


def test_lines_of_two_long_words(spark):
    one = "abcdefghijklmnopqrst uvwxyzabcdefghijk"
    rows = [(1, one), (2, one.replace("c", "1")), (3, "0" * 40), (4, "0" * 20 + "x" + "0" * 19)]
    decided = line_dedup.decisions(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in decided if r.n_dropped) == [2, 4]


def test_lines_of_the_same_words_in_other_orders_seldom_meet(spark):
    import random

    r = random.Random(5)
    words = [f"word{i}" for i in range(60)]
    lines = spark.createDataFrame([(k, " ".join(r.sample(words, 30)), 1) for k in range(100)], "id long, line string, copies int")
    made = line_dedup.prefixes(lines, line_dedup.word_classes(lines), 0.8).collect()
    keys = [set(x["keys"][: x.meets]) for x in made]
    assert sum(bool(keys[i] & keys[j]) for i in range(100) for j in range(i)) < 0.2 * 4950


def test_pairs_of_lines_in_shares(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARE", 3)
    rows = [(2 * k + i, f"a{k} b{k} c{k} d{k} e{k} f{k} g{k} h{k} i{k} {'jx'[i]}{k}") for k in range(12) for i in range(2)]
    decided = line_dedup.decisions(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.kept_doc_ids[0] for r in decided if r.n_dropped} == {2 * k + 1: 2 * k for k in range(12)}


def test_lines_of_repeated_rows(spark):
    line = " ".join(f"w{i}" for i in range(30))
    near = line.replace("w7 ", "v7 ")
    docs = spark.createDataFrame([(1, line)] * 40 + [(2, near)] * 3, "doc_id long, text string")
    decided = line_dedup.decisions(docs).collect()
    assert sorted((r.doc_id, r.n_dropped, tuple(r.dropped or ())) for r in decided) == [(1, 0, ())] * 40 + [(2, 1, (0,))] * 3


def test_lines_of_long_lists(spark, monkeypatch):
    """Lists beyond LONG lines: a group of near copies, and lines that share a word and nothing else."""
    import random

    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    base = [word() for _ in range(24)]
    rows = [" ".join(word() if i in (k % 24, (5 * k) % 24) else w for i, w in enumerate(base)) for k in range(40)]
    rows += [" ".join(["shared", *(word() for _ in range(9))]) for _ in range(40)] + ["de de le " * 20 + " ".join(word() for _ in range(3)) for _ in range(12)]
    rows = [re.sub(r" +", " ", x).strip() for x in rows]
    groups = closure(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if near(rows[i], rows[j])])
    monkeypatch.setattr(line_dedup, "LONG", 4)
    monkeypatch.setattr(links, "PIECE", 3)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    decided = {x.doc_id: x for x in line_dedup.decisions(docs).collect()}
    assert {i: decided[i].kept_doc_ids[0] if decided[i].n_dropped else i for i in decided} == groups


def test_lines_are_compared_before_pairs_are_written(spark, monkeypatch):
    """Short lines with a few trigrams in common, and long ones with a pair of words, of which none is near another."""
    import random

    r = random.Random(9)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    vocabulary, written, write = [word(6) for _ in range(300)], [], line_dedup.materialize

    class Made(Exception):
        pass

    def counted(df, name):
        if name in ("line-share", "near-lines"):
            raise Made
        out = write(df, name)
        written.append(out.count() if name == "line-pairs" else 0)
        return out

    monkeypatch.setattr(line_dedup, "materialize", counted)
    monkeypatch.setattr(line_dedup, "LONG", 1)
    monkeypatch.setattr(line_dedup, "PASSES", 1)
    for lines in ([f"the {word(8)} {word(7)}" for _ in range(80)], [" ".join(r.sample(vocabulary, 100)) for _ in range(80)]):
        written.clear()
        with pytest.raises(Made):
            line_dedup.groups(spark.createDataFrame([(k, x, 1) for k, x in enumerate(lines)], "id long, line string, copies int"))
        assert sum(written) < 10


def test_pairs_of_long_lists_are_made_once(spark, monkeypatch):
    """Two groups of near copies that share a passage, and so many long lists: a pair is made in one of them."""
    import random

    r = random.Random(13)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    passage, rest = [word(4) for _ in range(40)], [[word(14) for _ in range(10)] for _ in range(2)]
    rows = [" ".join([*passage[:20], *rest[k % 2], *(word(14) for _ in range(2)), *passage[20:]]) for k in range(24)]
    pairs, made = links.pairs, []

    def counted(met, admissible):
        # rows of the search between components have what those of stars lack
        if "held" in met.columns:
            made.append(met.filter(admissible("l", "r")).count())
        return pairs(met, admissible)

    monkeypatch.setattr(links, "pairs", counted)
    monkeypatch.setattr(line_dedup, "LONG", 4)
    found = line_dedup.groups(spark.createDataFrame([(k, x, 1) for k, x in enumerate(rows)], "id long, line string, copies int"))
    assert {x.id: x.component for x in found.collect()} == {k: k % 2 for k in range(24)}
    assert made and 0 < sum(made) <= 12 * 12


def test_movable_words_allow_for_lengths(spark):
    rows = [(10, 10, 8), (10, 8, 6), (50, 44, 18), (50, 50, 24)]
    got = spark.createDataFrame(rows, "m int, n int, want int").select(line_dedup.movable(F.col("m"), F.col("n"), 0.8).alias("got"), "want")
    assert all(x.got == x.want for x in got.collect())


def test_native_operators_use_no_python(docs, sf_dir, spark):
    for df in (line_dedup.decisions(docs), line_dedup.dedup(docs), spotsigs.edited(docs), spotsigs.near_duplicates(docs)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def test_edited(docs, empty, texts):
    rows = docs.collect()
    order = sorted(((r.doc_id, r.text or "") for r in rows), reverse=True)
    want = []
    for k, (i, t) in enumerate(order):
        third = len(t) // 3
        e = t[: len(t) - third] + order[(k + 1) % len(order)][1][:third]
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest()))
    got = spotsigs.edited(docs, rows_per_bucket=4).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    prints = {}
    for r in got:
        prints.setdefault(r.doc_id, set()).add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        a, b = set(r.fingerprint.split()), set(r.edited_fingerprint.split())
        assert r.near_edited == pytest.approx(len(a & b) / len(a | b) if a | b else 1)
    assert prints[rows and sorted(r.doc_id for r in rows if r.text == texts[5])[0]] == prints[sorted(r.doc_id for r in rows if r.text == texts[6])[-1]]
    assert spotsigs.edited(empty).count() == 0
    assert [r.near_next for r in spotsigs.edited(docs.filter("doc_id = 30").limit(1)).collect()] == [1.0]


def test_signatures(spark):
    df = spark.createDataFrame([("The quick fox and the of lazy dog sleeps",)], "text string")
    anchors = {"en": ["the", "and", "of"]}
    chains = ["the>quick fox", "of>lazy dog"]  # the last anchor of a run names it
    want = spark.createDataFrame([(c,) for c in chains], "c string").select(F.xxhash64("c")).collect()
    assert sorted(spotsigs.with_signatures(df, "text", "s", 2, anchors).first().s) == sorted(r[0] for r in want)


def test_signatures_are_local(spark):
    """Texts with and without anchors, a third of which is replaced by another text, stay half alike."""
    import random

    r = random.Random(5)
    word = lambda: "".join(r.choice("bcdfghklmnprstvz") for _ in range(5))
    kinds = [lambda: " ".join(r.choice(["the", "of", "and", word(), word(), word()]) for _ in range(300)), lambda: " | ".join(word() for _ in range(300)), lambda: " ".join(word() if i % 100 > 20 else "the " + word() for i in range(300))]
    texts = [k() for k in kinds for _ in range(4)]
    rows = [(t, t[: len(t) - len(t) // 3] + o[: len(t) // 3]) for t in texts for o in texts if o != t]
    df = spark.createDataFrame(rows, "a string, b string")
    made = spotsigs.with_signatures(spotsigs.with_signatures(df, "a", "s"), "b", "e").select(spotsigs.likeness("s", "e").alias("x"))
    assert made.agg(F.min("x")).first()[0] >= 0.25


def plain_signatures(text):
    """Chains of two content words after a run of common words, and words of long runs without one; as strings."""
    common = {w for own in spotsigs.ANCHORS.values() for w in own}
    words = re.findall(r"[^\W_]+", text.lower())
    out, runs, run = set(), [], []
    for i, w in enumerate(words):
        if w in common:
            runs.append(run)
            run = []
            if i + 1 == len(words) or words[i + 1] not in common:
                rest = [x for x in words[i + 1 :] if x not in common][:2]
                if len(rest) == 2:
                    out.add(f"{w}>{rest[0]} {rest[1]}")
        else:
            run.append(w)
    out |= {w for own in [*runs, run] if len(own) >= spotsigs.RUN for w in own}
    return out or set(words)


def test_signatures_against_plain_ones(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts) if t and re.search(r"[^\W_]", t)]
    want = spark.createDataFrame([(i, s) for i, t in rows for s in plain_signatures(t)], "i int, s string").groupBy("i").agg(F.array_sort(F.collect_set(F.xxhash64("s"))).alias("s"))
    got = spotsigs.with_signatures(spark.createDataFrame(rows, "i int, text string"), "text", "s")
    assert {r.i: r.s for r in got.collect()} == {r.i: r.s for r in want.collect()}


def test_near_duplicates(docs, empty):
    rows = spotsigs.with_signatures(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "s").collect()
    sets = [set(r.s) for r in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    groups = closure(range(len(rows)), edges)
    least = {}
    for i, g in groups.items():
        least[g] = min(least.get(g, rows[i].doc_id), rows[i].doc_id)
    assert sorted(map(tuple, spotsigs.near_duplicates(docs).collect())) == sorted((r.doc_id, least[groups[i]]) for i, r in enumerate(rows))
    assert spotsigs.near_duplicates(empty).count() == 0


def test_topk(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(i, [((i * 37 + j * 11) % 50 - 25) / 9 for j in range(20)]) for i in range(60)]
    vectors += [(100, None), (101, [None] * 20), (102, [nan] * 20), (103, [inf] * 20), (104, []), (105, [1.0]), vectors[3], (None, [1.0] * 20)]
    df = spark.createDataFrame([(*v, 1, "x") for v in vectors], "vec_id long, embedding array<float>, block int, ids string").repartition(3)
    q = topk.quantize(df)
    rows = [(r.vec_id, r.v) for r in q.collect()]
    assert {i for i, _ in rows} == {*range(60), 104, 105}
    want = []
    for i, v in rows:
        if i % 5 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in rows if j != i)
            want += [(i, k, j, -s) for k, (s, j) in enumerate(scored[:7], 1)]
    got = topk.search(q, q.filter("vec_id % 5 = 0"), 7, candidate_block=8, query_block=4, group=2)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.search(q.limit(0), q, 3).count() == 0
