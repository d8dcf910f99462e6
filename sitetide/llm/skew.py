"""Joins on keys of which a few may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of all rows is hot; so there are fewer hot keys than this number.
PARTS = 1000


def join_hot(rows: DataFrame, keyed: DataFrame, keys: list[str], weight: str, parts: int = PARTS) -> DataFrame:
    """``rows`` joined to ``keyed``, which has each key once with its number of rows in ``weight``.

    Keys with more than one in ``parts`` of all rows are fewer than ``parts``, so they are broadcast and their rows stay
    where they are; the other rows meet their keys by a shuffle. Null keys find nothing, as in any inner join.
    """
    total = keyed.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) > max(1, total // parts)
    hot = keyed.filter(is_hot)
    by_broadcast = rows.join(F.broadcast(hot), keys)
    others = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return by_broadcast.unionByName(others.join(keyed.filter(~is_hot), keys))
