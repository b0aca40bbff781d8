"""Row-offset windows over long series, cut into overlapping chunks.

Lags and trailing frames look back a fixed number of rows, so a series can be
cut into chunks if each chunk also gets the rows it looks back (or ahead) on.
A zone holding a third of all rows is then spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from zonecast.operators.ordering import row_positions

CHUNK_ROWS = 4096


def hour_number(ts: str | Column) -> Column:
    """Whole hours since 1970-01-01."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("HOUR", F.expr("timestamp_ntz'1970-01-01'"), column.cast("timestamp_ntz"))


def over_history(
    df: DataFrame,
    columns: Callable[[WindowSpec], dict[str, Column]],
    back: int,
    forward: int = 0,
    keys: Sequence[str] = ("zone",),
    order: str = "timestamp",
    dense: bool = False,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add window columns that look at most `back` rows behind and `forward` rows ahead.

    `columns` gets the window (partitioned and ordered) and returns the columns
    to add. All of them share one shuffle and one sort. `dense=True` says that
    each series has exactly one row per hour without gaps (as `panel.spine`
    makes it); otherwise row positions are counted first, so gaps are fine.
    """
    keys = list(keys)
    size = max(chunk_rows, back, forward, 1)
    if dense:
        placed = df.withColumn("_pos", hour_number(order))
    else:
        placed = row_positions(df, order, keys, name="_pos")
    chunk = F.floor(F.col("_pos") / size)
    offset = F.col("_pos") - chunk * size
    homes = [F.struct(chunk.alias("chunk"), F.lit(True).alias("own"))]
    if back:
        homes.append(F.when(offset >= size - back, F.struct((chunk + 1).alias("chunk"), F.lit(False).alias("own"))))
    if forward:
        homes.append(F.when(offset < forward, F.struct((chunk - 1).alias("chunk"), F.lit(False).alias("own"))))
    spread = placed.withColumn("_home", F.explode(F.array_compact(F.array(*homes)))).select(
        *df.columns, F.col("_home.chunk").alias("_chunk"), F.col("_home.own").alias("_own")
    )
    window = Window.partitionBy(*keys, "_chunk").orderBy(order)
    return spread.withColumns(columns(window)).where("_own").drop("_chunk", "_own")
