"""The operators of this subpackage as queries over the supplied tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, line_dedup, lm, ngram_join, packing, pii, quality, spotsigs, topk, warc
from ._util import read_table


def _tokenizer(name: str) -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derive(warc.responses(read_table(spark, sf_dir, "pages")))
    named = {"refers_to": "WARC-Refers-To", "refers_to_target_uri": "WARC-Refers-To-Target-URI", "refers_to_date": "WARC-Refers-To-Date", "block_digest": "WARC-Block-Digest", "content_type": "Content-Type", "content_length": "Content-Length"}
    return made.select("record_id", "type", "target_uri", "date", *[F.col("headers")[h].alias(c) for c, h in named.items()], F.decode("block", "UTF-8").alias("block"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read_table(spark, sf_dir, "documents"))


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), *_tokenizer("byte_bpe_50k.json"))


def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited(read_table(spark, sf_dir, "documents"))


def op5_spotsigs_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.near_duplicates(read_table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read_table(spark, sf_dir, "documents"), *_tokenizer("byte_bpe_multi_50k.tiktoken"), emit=bpe.digest, schema=bpe.DIGEST)


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.decisions(read_table(spark, sf_dir, "documents"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantize(read_table(spark, sf_dir, "embeddings"))
    return topk.search(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read_table(spark, sf_dir, "documents"), n=3, percent=90)


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigrams; a document is scored by the counts of all others, as its own would make every n-gram a known one."""
    return lm.score(read_table(spark, sf_dir, "documents"), order=3, leave_out=True).withColumn("log_score", F.round("log_score", 3))


QUERIES = {f.__name__: f for f in (op1_quality, op2_warc, op3_pii, op4_pack, op5_spotsigs, op5_spotsigs_groups, op6_bpe, op7_lines, op8_topk, op9_ngram_join, op10_lm)}

#: SQL for the operators that it can express.
ORACLES = {
    "op8_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op9_ngram_join": """
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) END) AS s FROM w
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
        SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id
        FROM documents d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op10_lm": """
        WITH w AS (
            SELECT doc_id, generate_subscripts(s, 1) AS i, unnest(s) AS w
            FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS s FROM documents)
        ), p AS (
            SELECT doc_id, i, w, lag(w) OVER o AS c, lag(w, 2) OVER o AS b FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)
        ), own AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id), total AS (SELECT count(*) AS n FROM w),
        one AS (SELECT doc_id, w, count(*) AS n, sum(count(*)) OVER (PARTITION BY w) - count(*) AS o FROM p GROUP BY doc_id, w),
        two AS (SELECT doc_id, c, w, count(*) AS n, sum(count(*)) OVER (PARTITION BY c, w) - count(*) AS o FROM p WHERE c IS NOT NULL GROUP BY doc_id, c, w),
        three AS (SELECT doc_id, b, c, w, sum(count(*)) OVER (PARTITION BY b, c, w) - count(*) AS o FROM p WHERE b IS NOT NULL GROUP BY doc_id, b, c, w),
        s AS (
            SELECT p.doc_id, CASE WHEN three.o > 0 THEN ln(three.o / before.o)
                WHEN two.o > 0 THEN ln(two.o / context.o) + CASE WHEN p.b IS NULL THEN 0 ELSE ln(0.4) END
                WHEN one.o > 0 THEN ln(one.o / (total.n - own.n)) + (CASE WHEN p.b IS NULL THEN 0 ELSE ln(0.4) END) + (CASE WHEN p.c IS NULL THEN 0 ELSE ln(0.4) END)
                ELSE -ln(total.n - own.n + 1) + (CASE WHEN p.b IS NULL THEN 0 ELSE ln(0.4) END) + (CASE WHEN p.c IS NULL THEN 0 ELSE ln(0.4) END) END AS score
            FROM p JOIN own ON own.doc_id = p.doc_id JOIN one ON one.doc_id = p.doc_id AND one.w = p.w
            LEFT JOIN one context ON context.doc_id = p.doc_id AND context.w = p.c
            LEFT JOIN two ON two.doc_id = p.doc_id AND two.c = p.c AND two.w = p.w
            LEFT JOIN two before ON before.doc_id = p.doc_id AND before.c = p.b AND before.w = p.c
            LEFT JOIN three ON three.doc_id = p.doc_id AND three.b = p.b AND three.c = p.c AND three.w = p.w CROSS JOIN total
        ), t AS (SELECT doc_id, count(*) AS n, sum(score) AS score FROM s GROUP BY doc_id)
        SELECT d.doc_id, coalesce(t.n, 0) AS n_words, round(coalesce(t.score, 0), 3) AS log_score FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id""",
}
