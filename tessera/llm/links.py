"""Groups of linked items: connected components, and the components of similarity links found through shared keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import materialize, release

#: A list's rows are dealt into pieces of so many, and into so many pieces at most, when rows of other components are looked for.
PIECE, PIECES = 4096, 256


def connected(edges: DataFrame, name: str = "component") -> DataFrame:
    """(id, component): the smallest id that every id of ``edges`` (a, b) reaches, by alternating large and small stars.

    Each round sends every neighbour to the least one around; edges never grow in number. Minima are found by aggregation
    and joined back, so that a hub's edges can be split over tasks. Null ends are dropped. A round's table goes when the
    next one is written.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    now, before = materialize(now, name), None
    while (seen := tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 31))).first())) != before and seen[0]:
        before = seen
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        last = now
        now = materialize(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
        release(last)
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def stars(lists: DataFrame, admissible) -> DataFrame:
    """Pairs (a, b) of every item with the heaviest one of each list that it is in, where they are admissible."""
    # weight and id as one number, which is compared without sorting: two of equal weight and low bits are both heads
    order = F.least(F.col("weight"), F.lit((1 << 20) - 1)) * (1 << 43) + F.col("id").bitwiseAND(F.lit((1 << 43) - 1))
    ranked = lists.withColumn("order", order)
    heads = ranked.groupBy("key").agg(F.max("order").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "head")
    # the head's own row carries what admissible() asks of it
    of_heads = ranked.join(heads, "key").filter("order = head").drop("head", "order")
    met = lists.alias("l").join(of_heads.alias("r"), "key").filter(F.col("l.id") != F.col("r.id"))
    return pairs(met, admissible)


def across(lists: DataFrame, component: DataFrame, admissible, name: str, of_items: DataFrame | None = None) -> DataFrame:
    """Admissible pairs (a, b) that share a list and lie in different components; lists within one component are dropped.

    ``of_items`` holds, by id, what else ``admissible`` needs of the rows of the lists that are left. One side's rows of a list of more than PIECE are dealt into pieces, and the other side's are copied to each, so that
    it takes as many tasks.
    """
    labelled = lists.join(component, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n")).filter("low <> high")
    pieces = F.least(F.ceil(F.col("n") / PIECE), F.lit(PIECES)).cast("long").alias("pieces")
    rest = labelled.join(mixed.select("key", pieces), "key")
    rest = materialize(rest if of_items is None else rest.join(of_items, "id"), f"{name}-rest")
    one = rest.withColumn("salt", F.pmod("id", F.col("pieces"))).drop("pieces")
    other = rest.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))).drop("pieces")
    met = one.alias("l").join(other.alias("r"), ["key", "salt"]).filter(F.col("l.component") < F.col("r.component"))
    found = materialize(pairs(met, admissible), f"{name}-met")
    release(rest)
    return found


def linked(lists: DataFrame, admissible: Callable[[str, str], Column], verify: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Components (id, component) of the links among items that share a key; items without a link do not appear.

    ``lists`` holds key, id, weight and whatever ``admissible`` needs of two rows with the same key (it gets two aliases).
    ``verify`` keeps the pairs (a, b) that are links. Every link must show up as an admissible pair under some key.

    All pairs of a list are never made. First each item meets only its list's heaviest one (in a group of near copies,
    often the text that the others were copied from). What that joins is one component, and inside a component no further
    pair can matter; then only pairs across components are left.
    """
    first = materialize(verify(stars(lists, admissible)), f"{name}-stars")
    component = materialize(connected(first, f"{name}-component"), f"{name}-components")
    second = materialize(verify(across(lists, component, admissible, name)), f"{name}-across")
    out = materialize(connected(first.unionByName(second), f"{name}-component"), f"{name}-all-components")
    release(first, component, second)
    return out


def pairs(met: DataFrame, admissible) -> DataFrame:
    """Distinct admissible pairs (a, b) among rows l and r that met, each with the smaller id first."""
    return met.filter(admissible("l", "r")).select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")).distinct()
