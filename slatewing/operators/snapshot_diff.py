"""Typed changes between consecutive full snapshots.

The rows of all snapshots of a group lie in one range-partitioned, key-sorted layout
``(group, key, position)``. Within a range the merge walks two pointers over that order: the
current row and the row before it. They belong to adjacent snapshots of the same key (compare the
columns), or a gap lies between them (the key left and came back), or they have different keys.

Only digests of the compared columns travel through the shuffle, one 64-bit hash a column, so that
the changed columns can be named without carrying long texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatewing.session import counted_broadcast

#: Snapshots up to which their order (a few short columns) is broadcast.
ORDER_ROWS = 200_000
#: Any Unicode white space, line ends included.
BLANKS = r"(?U)[\s\x{feff}]+"


def squeezed(c: Column) -> Column:
    """Blanks at the ends removed, inner runs as one space, null as the empty text."""
    return F.coalesce(F.trim(F.regexp_replace(c.cast("string"), BLANKS, " ")), F.lit(""))


def valid_versions(tasks: DataFrame) -> DataFrame:
    """One row a task: that of the highest version (ties: latest created_at, then any).

    Rows without id are left out; a null version counts as lowest.
    """
    rank = F.struct(
        F.coalesce(F.col("version").cast("long"), F.lit(-(2**63 - 1))).alias("v"),
        F.coalesce(F.col("created_at"), F.lit("1900-01-01").cast("timestamp")).alias("c"),
    )
    kept = F.struct("project_id", "status", "created_at")
    return (
        tasks.where(F.col("id").isNotNull())
        .groupBy(F.col("id").alias("task_id"))
        .agg(F.max_by(kept, rank).alias("r"))
        .select("task_id", "r.project_id", "r.status", "r.created_at")
    )


def snapshot_order(tasks: DataFrame, status: str = "COMPLETED") -> DataFrame:
    """``(task_id, project_id, position, next_task_id)`` of the snapshots of each project."""
    order = Window.partitionBy("project_id").orderBy("created_at", "task_id")
    return (
        valid_versions(tasks)
        .where((F.col("status") == status) & F.col("project_id").isNotNull())
        .select(
            "task_id",
            "project_id",
            (F.row_number().over(order) - 1).alias("position"),
            F.lead("task_id").over(order).alias("next_task_id"),
        )
    )


def latest_states(
    rows: DataFrame, snapshot: str, key: Column, recency: str, compared: dict[str, Column]
) -> DataFrame:
    """One row a (snapshot, key): ``(snapshot, key, state array<bigint>)`` of the latest delivery.

    ``state`` holds a hash for each compared column. Equal recency: the largest state, so that the
    choice does not depend on the order of rows. Aggregates map-side before the shuffle, so a key
    that holds much of the input is no hot spot.
    """
    state = F.array(*[F.xxhash64(c) for c in compared.values()])
    digest = rows.select(
        F.col(snapshot).alias("snapshot"), key.alias("key"), F.col(recency).alias("recency"), state.alias("state")
    ).where(F.col("snapshot").isNotNull() & F.col("key").isNotNull() & (F.col("key") != ""))
    newest = F.struct(F.coalesce(F.col("recency"), F.lit("1900-01-01").cast("timestamp")), "state")
    return digest.groupBy("snapshot", "key").agg(F.max_by("state", newest).alias("state"))


def merge_changes(states: DataFrame, order: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(task_id, key, change, changed_columns)`` from the key-sorted merge.

    ``states``: ``(snapshot, key, state)``; ``order``: as of :func:`snapshot_order`. A snapshot may
    have no rows: its predecessor's keys are then REMOVED. Groups of one snapshot give no rows.
    """
    # a snapshot holds many rows: its place is brought to them, so that no task's rows meet in one partition
    placed = (
        states.join(counted_broadcast(order, ORDER_ROWS), states["snapshot"] == order["task_id"])
        .select("project_id", "key", "position", "task_id", "next_task_id", "state")
        # ranges are cut on (project, key), so that no range begins inside a key
        .repartitionByRange("project_id", "key")
        .sortWithinPartitions("project_id", "key", "position")
    )
    pointer = Window.partitionBy("project_id", "key").orderBy("position")
    walked = placed.select(
        "*",
        F.lag("position").over(pointer).alias("before"),
        F.lag("state").over(pointer).alias("old"),
        F.lead("position").over(pointer).alias("after"),
    )
    adjacent = F.col("before") == F.col("position") - 1
    differing = F.filter(
        F.transform(F.array(*[F.lit(c) for c in columns]), lambda c, i: F.when(F.col("old")[i] != F.col("state")[i], c)),
        lambda c: c.isNotNull(),
    )
    none = F.array().cast("array<string>")

    def change(task: Column, kind: str, what: Column) -> Column:
        return F.struct(task.alias("task_id"), F.lit(kind).alias("change"), what.alias("changed_columns"))

    events = F.array(
        F.when((F.col("position") > 0) & ~F.coalesce(adjacent, F.lit(False)), change(F.col("task_id"), "ADDED", none)),
        F.when(adjacent & (F.col("old") != F.col("state")), change(F.col("task_id"), "CHANGED", differing)),
        F.when(
            F.col("next_task_id").isNotNull() & ~F.coalesce(F.col("after") == F.col("position") + 1, F.lit(False)),
            change(F.col("next_task_id"), "REMOVED", none),
        ),
    )
    return (
        walked.select("key", F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e"))
        .select(F.col("e.task_id").alias("task_id"), "key", F.col("e.change").alias("change"), F.col("e.changed_columns").alias("changed_columns"))
    )


#: Compared columns of a finding: name to normal form.
FINDING_COLUMNS = {
    "severity": lambda c: F.lower(squeezed(c)),
    "confidence": lambda c: F.lower(squeezed(c)),
    "title": squeezed,
    "start_line": squeezed,
    "end_line": squeezed,
    "endpoint": squeezed,
    "description": squeezed,
    "remediation": squeezed,
}


def finding_changes(findings: DataFrame, tasks: DataFrame) -> DataFrame:
    """What each completed task's findings added, removed or changed against the snapshot before.

    Returns ``(task_id, fingerprint, change, changed_columns)``. Findings with null or blank
    fingerprint, or of tasks that are not (or no longer) completed, are left out. Empty tables give
    an empty result; repeated rows make no difference; extra columns are ignored.
    """
    compared = {name: normal(F.col(name)) for name, normal in FINDING_COLUMNS.items()}
    key = F.lower(squeezed(F.col("fingerprint")))
    states = latest_states(findings, "task_id", key, "created_at", compared)
    changes = merge_changes(states, snapshot_order(tasks), list(compared))
    return changes.withColumnRenamed("key", "fingerprint")
