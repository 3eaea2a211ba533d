"""Connected components by alternating large-star and small-star steps.

Each step is one grouped minimum, combined before the shuffle, and a join of the edges with it, in which the edges of a vertex that
has very many can be split.  No component is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import cut, discard


#: Edges that are written to one file, about.
ROWS = 250_000


def _print(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(r)


def _with_least(e: DataFrame, key: str, value: str) -> DataFrame:
    """e with m, the least value of each key, itself included.

    The join is on another expression than the group, so both sides are dealt out for it and the rows of a key that has very many can be split.
    """
    low = e.groupBy(F.col(key).alias("c")).agg(F.least(F.min(value), F.col("c")).alias("m"))
    return e.join(low, F.bitwise_not(key) == F.bitwise_not("c")).drop("c")


def _each(e: DataFrame, *pairs: Column) -> DataFrame:
    """Rows of the structs that aren't null."""
    return e.select(F.inline(F.array_compact(F.array(*pairs))))


def _large(e: DataFrame) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    both = _each(e, F.struct(a.alias("u"), b.alias("v")), F.struct(b.alias("u"), a.alias("v")))
    return _with_least(both, "u", "v").where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small(e: DataFrame) -> DataFrame:
    a, b, m = F.col("a"), F.col("b"), F.col("m")
    return _each(_with_least(e, "a", "b"), F.struct(a.alias("a"), m.alias("b")), F.when(b > m, F.struct(b.alias("a"), m.alias("b")))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex of edges (a, b); the component is named by its smallest vertex.

    Self-loops, repeated and reversed edges change nothing; rows with a null end are ignored.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    every = cut(e.distinct(), "edges")  # written once, as edges can be much work
    loops = every.where(F.col("a") == F.col("b")).select(F.col("a").alias("id"))
    e = every.where(F.col("a") > F.col("b"))
    before = _print(e)
    while before[0]:
        new = cut(_small(_large(e)).coalesce(max(8, before[0] // ROWS)), "edges")  # few files for few edges
        after = _print(new)
        if "cut_path" in vars(e):
            discard(e)
        e, done, before = new, after == before, after
        if done:
            break
    found = e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = found.select(F.col("component").alias("id")).unionByName(loops).distinct().join(found.select("id"), "id", "left_anti")
    return found.unionByName(roots.select("id", F.col("id").alias("component")))
