"""Similarity join of short strings by character trigrams, and classes of what it links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.operators.ordered import written


def alike(strings: DataFrame, share: tuple[int, int] = (2, 5)) -> DataFrame:
    """name, other, distance: all pairs, name < other, of distinct strings (column s, not null) whose trigram sets have a Jaccard similarity of more than `share`.

    A string of under three characters is a gram of its own.  Alike sets share
    more than that part of either, so their first n - floor(share * n) grams,
    rarest first, have one in common: strings meet there in an equi-join, and
    are compared on whole sets.
    """
    p, q = share
    at = F.sequence(F.lit(1), F.greatest(F.length("s") - 2, F.lit(1)))
    sets = strings.select("s", F.array_distinct(F.transform(at, lambda i: F.substring("s", i, 3))).alias("g"))
    grams = sets.select("s", F.explode("g").alias("w"))
    ordered = grams.join(grams.groupBy("w").agg(F.count(F.lit(1)).alias("n")), "w").groupBy("s").agg(F.array_sort(F.collect_list(F.struct("n", "w"))).alias("o"))
    first = ordered.select("s", F.explode(F.slice("o", 1, F.size("o") - F.floor(F.size("o") * p / q).cast("int"))).alias("x")).select("s", "x.w")
    met = first.withColumnRenamed("s", "name").join(first.withColumnRenamed("s", "other"), "w").filter("name < other").select("name", "other").distinct()
    one, two = sets.select(F.col("s").alias("name"), F.col("g").alias("g1")), sets.select(F.col("s").alias("other"), F.col("g").alias("g2"))
    both = F.size(F.array_intersect("g1", "g2"))
    pairs = met.join(one, "name").join(two, "other").withColumns({"both": both, "all": F.size("g1") + F.size("g2") - both}).filter(F.col("both") * q > F.col("all") * p)
    return pairs.select("name", "other", F.round(1 - F.col("both") / F.col("all"), 6).alias("distance"))


def classes(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, class: the smallest node that links (a, b) lead to from each of nodes (column node), itself if none.

    Every round takes the smallest class among a node's neighbours and then
    the class of that class, so that long chains halve; each round is a written
    table.  Minima are taken before the shuffle, so a node of very many links
    is no task of its own.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).filter("a != b").distinct(), "class-links")
    now = written(nodes.select("node", F.col("node").alias("class")).distinct(), "classes")
    while True:
        near = both.join(now, both["b"] == now["node"]).groupBy("a").agg(F.min("class").alias("least"))
        step = now.join(near, F.col("node") == F.col("a"), "left").select("node", "class", F.least("class", F.coalesce("least", "class")).alias("least"))
        jump = now.select(F.col("node").alias("least"), F.col("class").alias("further"))
        nxt = written(step.join(jump, "least").select("node", F.col("class").alias("old"), F.least("least", "further").alias("class")), "classes")
        if nxt.filter("old != class").isEmpty():
            return nxt.drop("old")
        now = nxt.drop("old")


def similar_classes(names: DataFrame, column: str, share: tuple[int, int] = (2, 5)) -> DataFrame:
    """name, rows, links, class of each distinct lower-case string of a column: how many rows have it, how many other strings are alike(), and the smallest string that such links lead to.

    Nulls take no part; an empty string is a string; pairs are not returned, as
    they may be very many where strings are.
    """
    found = written(names.groupBy(F.lower(column).alias("s")).agg(F.count(F.lit(1)).alias("rows")).filter("s IS NOT NULL"), "similar-names")
    pairs = written(alike(found.select("s"), share), "similar-pairs")
    degree = pairs.select(F.explode(F.array("name", "other")).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("links"))
    roots = classes(found.select(F.col("s").alias("node")), pairs.select(F.col("name").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "s")
    return found.join(roots, "s").join(degree, "s", "left").select(F.col("s").alias("name"), "rows", F.coalesce("links", F.lit(0)).cast("long").alias("links"), "class")
