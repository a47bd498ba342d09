"""Sequential folds: pages, batches and windows whose next step depends on all steps before.

Each walks sorted rows as a stream and holds one group's running state only, never the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def greedy_batches(rows: DataFrame, group: str, order: str, size: str, most_rows: int, most_size: int) -> DataFrame:
    """``(group, order, size, batch)``: rows of a group in order, a new batch where one more row would
    exceed either limit. A row that alone exceeds the size has a batch of its own. Null sizes are 0."""
    kinds = dict(rows.dtypes)

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, batch, count, total = object(), 0, 0, 0
        for frame in frames:
            out = []
            for g, n in zip(frame[group], frame[size].fillna(0)):
                if g != current:
                    current, batch, count, total = g, 1, 0, 0
                if count and (count + 1 > most_rows or total + n > most_size):
                    batch, count, total = batch + 1, 0, 0
                count, total = count + 1, total + n
                out.append(batch)
            yield frame.assign(batch=out)

    placed = rows.select(group, order, size).where(F.col(group).isNotNull()).repartition(group).sortWithinPartitions(group, order)
    return placed.mapInPandas(walk, f"{group} {kinds[group]}, {order} {kinds[order]}, {size} {kinds[size]}, batch int")


def line_windows(text: Column, most_lines: int, most_chars: int) -> Column:
    """``array<struct<first,end,chars>>``: lines of a text in windows of at most ``most_lines`` lines and
    ``most_chars`` characters (each line and its end); a longer line stands alone."""
    rows = F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r", -1)
    empty = F.array().cast("array<struct<first:int,end:int,chars:int>>")
    start = F.struct(empty.alias("done"), F.lit(1).alias("first"), F.lit(0).alias("n"), F.lit(0).alias("chars"))

    def step(state: Column, line: Column) -> Column:
        size = F.length(line) + 1
        full = (state["n"] > 0) & ((state["n"] + 1 > most_lines) | (state["chars"] + size > most_chars))
        closed = F.struct(state["first"].alias("first"), (state["first"] + state["n"] - 1).alias("end"), state["chars"].alias("chars"))
        return F.struct(
            F.when(full, F.concat(state["done"], F.array(closed))).otherwise(state["done"]).alias("done"),
            F.when(full, state["first"] + state["n"]).otherwise(state["first"]).alias("first"),
            F.when(full, 1).otherwise(state["n"] + 1).alias("n"),
            F.when(full, size).otherwise(state["chars"] + size).alias("chars"),
        )

    def finish(state: Column) -> Column:
        last = F.struct(state["first"].alias("first"), (state["first"] + state["n"] - 1).alias("end"), state["chars"].alias("chars"))
        return F.concat(state["done"], F.array(last))

    return F.aggregate(rows, start, step, finish)
