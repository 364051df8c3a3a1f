"""Neighbours in a sequence: the next and previous row of the same entity, without gathering an entity.

Rows are range-partitioned by (entity, order), so an entity with a third of all rows lies in a third of the partitions.
Each partition is one sorted pass; the row beyond either end of a partition is carried from its neighbours, one row per
partition. ``order`` has to be unique within an entity for the result to be determined. Null entities are one entity, null
order comes first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import _range_staged


def with_neighbours(df: DataFrame, entity: list[str], order: list[str], following: dict[str, str] | None = None,
                    preceding: dict[str, str] | None = None, first: str | None = None) -> DataFrame:
    """``df`` with values of the next (``following``) and previous row (``preceding``) of the entity, by new column name.

    ``first`` names a flag for an entity's first row. Where there is no such row the values are null.
    """
    following, preceding = following or {}, preceding or {}
    parts = _range_staged(df, [F.col(c) for c in (*entity, *order)])
    whole = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate((*entity, *order))],
                     *[F.col(c).alias(f"f_{n}") for n, c in following.items()], *[F.col(c).alias(f"p_{n}") for n, c in preceding.items()])
    # the ends of each partition by a map-side aggregate, then one row per partition
    key = F.struct(*[F.col(c) for c in (*entity, *order)])
    ends = parts.groupBy("__part").agg(F.min_by(whole, key).alias("__head"), F.max_by(whole, key).alias("__tail"))
    by_part = Window.orderBy("__part")
    ends = ends.select("__part", F.lead("__head").over(by_part).alias("__after"), F.lag("__tail").over(by_part).alias("__before"))
    within = Window.partitionBy("__part").orderBy(*entity, *order)
    rows = parts.join(F.broadcast(ends), "__part", "left").withColumns({
        "__next": F.coalesce(F.lead(whole).over(within), F.col("__after")),
        "__last": F.coalesce(F.lag(whole).over(within), F.col("__before"))})

    def same(side: str):
        held = F.col(side).isNotNull()
        for i, c in enumerate(entity):
            held = held & F.col(side)[f"o{i}"].eqNullSafe(F.col(c))
        return held

    new = {n: F.when(same("__next"), F.col("__next")[f"f_{n}"]) for n in following}
    new.update({n: F.when(same("__last"), F.col("__last")[f"p_{n}"]) for n in preceding})
    if first:
        new[first] = ~same("__last")
    return rows.withColumns(new).drop("__part", "__after", "__before", "__next", "__last")
