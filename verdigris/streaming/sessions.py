"""Session state over turns: what carries over, and the recent messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _turns(rows: int | None = None):
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return w.rowsBetween(Window.unboundedPreceding if rows is None else -(rows - 1), 0)


def carry_over(turns: DataFrame) -> DataFrame:
    """The last user turn so far and how many there were."""
    user = F.when(F.col("role") == "user", F.col("turn"))
    return turns.select("conv_id", "turn", F.last(user, ignorenulls=True).over(_turns()).alias("last_user"), F.count(user).over(_turns()).alias("users_so_far"))


def recent(turns: DataFrame, n: int) -> DataFrame:
    """Size of the window of the last n messages at each turn."""
    w = _turns(n)
    return turns.select("conv_id", "turn", F.count(F.lit(1)).over(w).alias("kept"), F.sum(F.char_length("text")).over(w).alias("chars"), F.min("turn").over(w).alias("oldest"))


def inherited(turns: DataFrame, fields: list[str]) -> DataFrame:
    """Each field as last stated in its session."""
    return turns.withColumns({f: F.last(f, ignorenulls=True).over(_turns()) for f in fields})
