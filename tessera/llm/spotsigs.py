"""Document fingerprints by SpotSigs, in DataFrame operations only.

A signature is a chain of content words that follows a run of common words (its anchor). The fingerprint of a document is
the set of its signatures. Likeness is the Jaccard similarity of two sets; near duplicates are searched among sets of
fitting length only, through the signatures at the head of each set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._util import materialize, maybe_broadcast
from .links import linked

#: Common words of four languages, the anchors.
ANCHORS = {
    "en": "a an and are as at be but by for from had has have he her his in is it its not of on or she that the their they this to was were which with you".split(),
    "fr": "au aux avec ce ces dans de des du elle en est et il la le les leur ne par pas pour qu que qui sa se ses son sont sur un une".split(),
    "de": "als auch auf aus bei das dem den der des die ein eine einer es für hat ich im in ist mit nicht sich sie sind und von war zu".split(),
    "es": "al como con de del el en entre es esta fue ha la las lo los más no o para pero por que se ser sin su sus un una y".split(),
}


def words(text: Column) -> Column:
    """Lower-case words, one space around each."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def _any_of(words: list[str]) -> str:
    """A pattern for any of the words that reads every letter once: alternatives branch where words differ."""
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        heads.setdefault(w[:1], []).append(w[1:])
    ends = "" in heads
    parts = [c + _any_of(rest) for c, rest in heads.items() if c]
    if not parts:
        return ""
    inner = parts[0] if len(parts) == 1 and not ends else f"(?:{'|'.join(parts)})"
    return f"(?:{inner})?" if ends else inner


#: A run of so many content words without an anchor stands for itself.
RUN = 9


def with_signatures(df: DataFrame, text: str, out: str, chain: int = 2, anchors: dict[str, list[str]] = ANCHORS) -> DataFrame:
    """``df`` with a column ``out``: sorted distinct 64-bit hashes of the chains of ``chain`` content words after each run of anchors.

    Chains overlap, and anchors inside them do not count. Where RUN content words or more follow each other without an anchor
    (tables, other languages), each of these words is a signature as well; as chains are, that is decided by what stands
    there alone. A text without either has its words as signatures, one without words itself, the empty text none. Every step
    is a column of its own, so that none is computed twice.
    """
    common = _any_of([w for own in anchors.values() for w in own])
    df = df.withColumn("__words", words(F.col(text)))
    # "... of the quick brown fox ..." becomes "...|the>quick brown fox ...": the last word of the run names the anchor
    df = df.withColumn("__marked", F.regexp_replace("__words", f" (?:({common}) )++", "|$1>"))
    found = F.regexp_extract_all("__marked", F.lit(rf"\|(?=([^>|]+>[^ >|]+(?:(?: |\|[^>|]+>)[^ >|]+){{{chain - 1}}}))"), F.lit(1))
    hashed = lambda items: F.transform(items, lambda x: F.xxhash64(x))
    runs = F.regexp_extract_all("__marked", F.lit(rf"((?:[^|> ]++ ){{{RUN - 1},}}+[^|> ]++)"), F.lit(1))
    loose = F.flatten(F.transform(runs, lambda r: hashed(F.split(r, " "))))
    df = df.withColumn("__chains", F.transform(found, lambda x: F.xxhash64(F.when(x.contains("|"), F.regexp_replace(x, r"\|[^>|]*>", " ")).otherwise(x))))
    df = df.withColumn("__chains", F.concat("__chains", loose))
    single = hashed(F.filter(F.split("__words", " "), lambda x: x != ""))
    whole = F.when(F.length(text) == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(text)))
    chosen = F.when(F.size("__chains") > 0, F.col("__chains")).when(F.length("__words") > 2, single).otherwise(whole)
    return df.withColumn(out, F.array_sort(F.array_distinct(chosen))).drop("__words", "__marked", "__chains")


def likeness(x: str, y: str, least: float = 0.0) -> Column:
    """Jaccard similarity of two sets; 0 without looking at them where their lengths rule out ``least``. Two empty sets: 1."""
    a, b = F.size(x), F.size(y)
    common = F.size(F.array_intersect(x, y))
    value = F.when(a + b == 0, F.lit(1.0)).otherwise(common / (a + b - common))
    return value if least <= 0 else F.when(F.least(a, b) < least * F.greatest(a, b), F.lit(0.0)).otherwise(value)


def fingerprint(sigs: str) -> Column:
    """The set as a string: sorted hashes, separated by spaces."""
    return F.array_join(F.col(sigs).cast("array<string>"), " ")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, chain: int = 2) -> DataFrame:
    """doc_id and class_id (the smallest doc_id of its group of near duplicates) of every document of ``docs``.

    Null and empty texts match nothing; repeated rows are returned each; other columns are ignored; an empty table gives no
    rows.
    """
    text = F.coalesce("text", F.lit(""))
    base = materialize(with_signatures(docs.select("doc_id", text.alias("text")), "text", "s", chain).drop("text"), "signatures")
    base = base.withColumn("id", identity("s"))
    return base.join(classes(base, threshold), "id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def identity(sigs: str) -> Column:
    return F.xxhash64(sigs, F.size(sigs))


def classes(base: DataFrame, threshold: float = 0.8) -> DataFrame:
    """id and class_id (the smallest doc_id of a group of near duplicates) of the sets ``base`` (doc_id, id, s), without empty ones.

    Equal sets are one class. Classes are partitioned by the length of their sets, each into two neighbouring partitions,
    and listed there under the heads of their sets, which similar sets share.
    """
    distinct = materialize(base.filter("size(s) > 0").groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("weight"), F.min("s").alias("s")), "signature-classes")
    size = F.size("s")
    part = F.floor(F.log(size.cast("double")) / F.log(F.lit(1 / threshold)) + 1e-9)
    head = F.posexplode(F.slice("s", 1, F.greatest(F.lit(1), size - F.ceil(threshold * size).cast("int") + 1))).alias("pos", "sig")
    heads = distinct.select("id", "weight", size.alias("size"), part.alias("part"), head)
    lists = heads.select("id", "weight", "size", "pos", F.explode(F.array(F.struct("sig", F.col("part").alias("part")), F.struct("sig", (F.col("part") + 1).alias("part")))).alias("key"))
    lists = materialize(lists, "signature-lists")

    def admissible(a: str, b: str) -> Column:
        least = F.ceil(threshold * (F.col(f"{a}.size") + F.col(f"{b}.size")) / (1 + threshold) - 1e-9)
        fits = F.least(f"{a}.size", f"{b}.size") >= threshold * F.greatest(f"{a}.size", f"{b}.size")
        return fits & (F.col(f"{a}.size") - F.col(f"{a}.pos") >= least) & (F.col(f"{b}.size") - F.col(f"{b}.pos") >= least)

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(distinct.select(F.col("id").alias("a"), F.col("s").alias("x")), "a").join(distinct.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
        return both.filter(likeness("x", "y", threshold) >= threshold).select("a", "b")

    component = linked(lists, admissible, verify, "signatures")
    labelled = distinct.join(component, "id", "left").select("id", "doc_id", F.coalesce("component", "id").alias("component"))
    smallest = labelled.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    return labelled.join(smallest, "component").select("id", "class_id")


def edited(docs: DataFrame, chain: int = 2, rows_per_bucket: int = 2_000, most_buckets: int = 4_096) -> DataFrame:
    """Fingerprints of every text, of its edited text, and how like they are.

    The edited text has the last floor(n_chars / 3) code points replaced by the first as many (or all) of the next document
    by descending doc_id; after the last comes the first. Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited and near_next. Null texts count as empty; a null doc_id comes last; rows with the same doc_id
    follow each other by descending text; a single row is its own next; an empty table gives no rows.

    Neighbours are found in ranges of doc_id, each in one piece and of like size: only the first document of each range
    (``most_buckets`` at most) is sent on to the range above.
    """
    docs = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("place"), F.coalesce("text", F.lit("")).alias("text"))
    n = docs.count()
    buckets = max(1, min(most_buckets, -(-n // rows_per_bucket)))
    cuts = docs.agg(F.percentile_approx("place", [k / buckets for k in range(1, buckets)], 10 * buckets)).first()[0] if buckets > 1 and n else []
    bucket = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))).cast("array<bigint>"), lambda x: x <= F.col("place")))
    spread = docs.withColumn("bucket", bucket)
    tops = spread.groupBy("bucket").agg(F.max("place").alias("top"))
    heads = docs.join(F.broadcast(tops), F.col("place") == F.col("top")).groupBy("bucket").agg(F.max("text").alias("head"))  # a row for each range
    heads = materialize(heads, "heads")
    # a number for each range, of most_buckets at most; the texts follow by a join
    below, last = Window.orderBy("bucket"), Window.orderBy(F.desc("bucket"))
    order = heads.select("bucket").withColumn("before", F.lag("bucket").over(below)).withColumn("wrapped", F.first("bucket").over(last))
    heads = order.select(F.col("bucket").alias("of"), F.coalesce("before", "wrapped").alias("bucket")).join(heads, "bucket").drop("bucket")
    heads = with_signatures(heads, "head", "head_s", chain)
    held = heads.agg(F.coalesce(F.sum(F.octet_length("head") + 8 * F.size("head_s")), F.lit(0))).first()[0]

    sigs = with_signatures(spread.repartition("bucket"), "text", "s", chain)
    order = Window.partitionBy("bucket").orderBy(F.desc("place"), F.desc("text"))
    moved = sigs.withColumn("next", F.lead("text").over(order)).withColumn("next_s", F.lead("s").over(order))
    # at the end of a range, the head of the range below stands in for the next document
    joined = moved.join(maybe_broadcast(heads, held, 1), F.col("next").isNull() & (F.col("bucket") == F.col("of")), "left")
    joined = joined.withColumn("next", F.coalesce("next", "head")).withColumn("next_s", F.coalesce("next_s", "head_s"))
    size = F.length("text")
    third = F.floor(size / 3).cast("int")
    made = joined.select("doc_id", size.cast("long").alias("n_chars"), "s", "next_s", F.concat(F.left("text", size - third), F.left("next", third)).alias("edited"))
    made = with_signatures(made, "edited", "e", chain)
    return made.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint("s").alias("fingerprint"), fingerprint("e").alias("edited_fingerprint"), likeness("s", "e").alias("near_edited"), likeness("s", "next_s").alias("near_next"))
