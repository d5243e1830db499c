"""Connected components of a graph whose edges and labels stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import discard, join_counted, written


def _follow(m: DataFrame, far: DataFrame) -> DataFrame:
    """m (v, up) with each up replaced by what far (v, up) has for it, if anything, and the old one as old."""
    steps = m.groupBy("up").agg(F.count("*").alias("n")).join(far.select(F.col("v").alias("up"), F.col("up").alias("further")), "up", "left")
    steps = written(steps.select("up", "n", F.coalesce("further", "up").alias("further")))
    out = written(join_counted(m, steps, "up").select("v", F.col("further").alias("up"), F.col("up").alias("old")))
    discard(steps)
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, label) for every vertex on an edge; label is the least vertex of its component.

    Each round ties every vertex to its least neighbour, follows these ties to their roots (ever twice
    as far) and goes on with the edges between roots, so tables shrink from round to round; at the
    end the rounds' ties are followed one after another.  Each table is written, and deleted when it is
    done with.  Vertices of very many edges are few and are joined by broadcast, so no task gathers them.
    Null ends are left out; an empty table gives no rows.
    """
    e = written(edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    rounds = []
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ties = written(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("least"), F.count("*").alias("n")).select("v", F.least("v", "least").alias("up"), "n"))
        roots = ties.select("v", "up")
        while True:
            further = _follow(roots, roots)
            if hasattr(roots, "held"):
                discard(roots)
            roots = further
            if roots.filter("up <> old").isEmpty():
                break
        rounds.append(roots)
        ends = written(ties.select("v", "n").join(roots.select("v", "up"), "v"))  # with how many edges each vertex has
        moved = join_counted(e, ends.withColumnsRenamed({"v": "a", "up": "x"}), "a").drop("n")
        moved = join_counted(moved, ends.withColumnsRenamed({"v": "b", "up": "y"}), "b").filter("x <> y")
        left = written(moved.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
        discard(e, ties, ends)
        e = left
        if e.isEmpty():
            break
    discard(e)
    labels = rounds.pop()
    while rounds:
        earlier = rounds.pop()
        new = _follow(earlier.select("v", "up"), labels)
        discard(earlier, labels)
        labels = new
    return labels.select("v", F.col("up").alias("label"))
