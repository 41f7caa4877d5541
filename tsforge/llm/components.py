"""Connected components of an edge table, by contraction.

Every vertex points to the smallest vertex next to it (itself included), pointers are followed
once more, and the edges are renamed and made distinct. Vertex ids are hashes, so their order is
random and a round leaves a fraction of the vertices; hubs need no special care, since minima
combine before the shuffle. Each round ends in written tables; the maps of all rounds are composed
at the end. Nothing is gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsforge.llm.base import materialise


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every vertex of ``edges`` (a long, b long); root is in the component.

    Loops and repeated edges are harmless; an empty edge table gives an empty result.
    """
    live = materialise(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    maps = []
    while not live.isEmpty():
        ends = live.select(F.col("a").alias("id"), F.col("b").alias("near")).union(live.select("b", "a"))
        least = ends.groupBy("id").agg(F.min("near").alias("near"))
        pointer = least.select("id", F.least("id", "near").alias("next"))
        hop = pointer.select(F.col("id").alias("next"), F.col("next").alias("root"))
        maps.append(materialise(pointer.join(hop, "next").select("id", "root"), "roots"))
        left = maps[-1].select(F.col("id").alias("a"), F.col("root").alias("x"))
        right = maps[-1].select(F.col("id").alias("b"), F.col("root").alias("y"))
        renamed = live.join(left, "a").join(right, "b").filter("x <> y")
        live = materialise(
            renamed.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges"
        )
    if not maps:
        return live.select(F.col("a").alias("id"), F.col("b").alias("root"))
    out = maps[-1]
    for earlier in reversed(maps[:-1]):
        later = out.select(F.col("id").alias("root"), F.col("root").alias("end"))
        out = earlier.join(later, "root", "left").select("id", F.coalesce("end", "root").alias("root"))
    return out
