"""Joins on keys of which one may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this part of all rows is hot, so fewer keys than that are.
PARTS = 1024


def join_counted(left: DataFrame, right: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """The inner join of ``left`` with ``right``, unique by ``on``, whose column ``count`` says how many rows of ``left`` have the key.

    The counts add up to ``total`` at most, so that fewer than ``PARTS`` keys have more than ``total / PARTS``
    rows: these are broadcast and their rows aren't moved.  All others are dealt by the key, and no key is large.
    """
    hot = F.col(count) * PARTS > total
    few = F.broadcast(right.where(hot))
    cold = left.join(few, on, "left_anti").join(right.where(~hot).hint("merge"), on)
    return left.join(few, on).unionByName(cold)
