"""Connected components of a link table, by alternating large-star and small-star steps.

Links never leave the executors.  Each step is written to the shared folder, which cuts
lineage; a count and a checksum come to the driver to see whether anything changed.
Hub nodes meet only in joins and partial aggregates, which Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamtext.llm.common import written


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v"), F.col("u")))
    return both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v")


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links(u, v)`` to ``(node, label)``; label is the least node of the component.

    Nodes without a link do not occur.  Self links and repeated links do no harm.
    """
    links = written(links.where("u <> v").distinct(), "links")
    state = _state(links)
    for _ in range(max_rounds):
        links = written(_small_star(_large_star(links).distinct()).distinct(), "links")
        now = _state(links)
        if now == state:
            labels = links.select(F.col("u").alias("node"), F.col("v").alias("label"))
            roots = links.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            return labels.union(roots)
        state = now
    raise RuntimeError("components did not settle")
