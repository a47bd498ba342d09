"""Queries on event logs and sequential folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slatewing.operators import folds
from slatewing.operators.prefix import running
from slatewing.plans.code_rules import _LINES
from slatewing.session import table
from slatewing.streaming import events as S


def event_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each task's events once, in order of their ids, as a subscriber receives them."""
    e = S.unique(table(spark, sf_dir, "agent_event").select("task_id", "event_id", "agent_type", "event_type", F.substring("message", 1, S.MESSAGE_LIMIT).alias("message")), "event_id")
    e = e.select("task_id", "event_id", "agent_type", "event_type", F.length("message").alias("characters"))
    return running(e, ["task_id"], ["event_id"]).select("task_id", F.col("place").cast("int").alias("place"), "event_id", "agent_type", "event_type", "characters")


def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each (task, agent, kind)."""
    e = table(spark, sf_dir, "agent_event")
    return e.groupBy("task_id", "agent_type", "event_type").agg(F.min("event_id").alias("event_id"))


def latest_n_detail(spark: SparkSession, sf_dir: str, detailed: int = 3, short: int = 80, budget: int = 6000) -> DataFrame:
    """Each task's observations, newest first: the latest whole, older ones shortened, until the budget ends."""
    e = table(spark, sf_dir, "agent_event").where("event_type = 'OBSERVATION' and message is not null").groupBy("task_id", "event_id").agg(F.max(F.length("message")).alias("n"))
    # what the first ones show beyond the short form is added to all that follow
    e = e.withColumn("back", -F.col("event_id")).withColumn("brief", F.least("n", F.lit(short)))
    newest = e.withColumn("k", F.row_number().over(Window.partitionBy("task_id").orderBy("back"))).where(F.col("k") <= detailed)
    more = newest.groupBy(F.col("task_id").alias("_task")).agg(F.array_sort(F.collect_list(F.struct("k", (F.col("n") - F.col("brief")).alias("m")))).alias("more"))
    ranked = running(e, ["task_id"], ["back"], "brief").join(more, F.col("task_id").eqNullSafe(F.col("_task")))
    extra = F.aggregate(F.filter("more", lambda x: x["k"] < F.col("place")), F.lit(0).cast("long"), lambda a, x: a + x["m"])
    shown = F.when(F.col("place") <= detailed, F.col("n")).otherwise(F.col("brief"))
    return ranked.select("task_id", "event_id", F.col("place").cast("int").alias("place"), F.least(shown, budget - F.col("before") - extra).cast("long").alias("shown")).where("shown > 0")


def running_budget(spark: SparkSession, sf_dir: str, budget: int = 200_000) -> DataFrame:
    """Characters used so far by the documents of each source in order, within a budget; the last in part."""
    d = running(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), ["source"], ["doc_id"], "n_chars")
    return d.select("source", "doc_id", F.greatest(F.lit(0), F.least(F.col("n_chars"), budget - F.col("before"))).cast("long").alias("used")).where("used > 0")


def greedy_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed pieces of each task in batches of ten units and 60,000 characters (1,000 for each unit)."""
    c = table(spark, sf_dir, "code_chunk").where("analysis_scope = 'CHANGED'").groupBy("task_id", "id").agg((F.max(F.length("content")) + 1000).alias("size"))
    return folds.greedy_batches(c, "task_id", "id", "size", 10, 60_000)


def greedy_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each piece in windows of at most 160 lines and 12,000 characters."""
    c = table(spark, sf_dir, "code_chunk").where("content is not null")
    return c.select("id", F.explode(folds.line_windows(F.col("content"), 160, 12_000)).alias("w")).select("id", "w.first", "w.end", "w.chars").distinct()


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_event_time(table(spark, sf_dir, "events"), "ts")


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.tumbling(_events(spark, sf_dir), "ts", "1 hour", ["event_type"])


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.tumbling(_events(spark, sf_dir), "ts", "2 hours", ["event_type"], slide="1 hour")


def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sessions(_events(spark, sf_dir), "ts", "30 minutes", "user_id")


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.unique(_events(spark, sf_dir).select("event_id", "user_id", "event_type"), "event_id")


def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by a key inside JSON texts; what does not parse has none."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").groupBy("event_type", (k % 10).alias("bucket")).agg(F.count("*").alias("events"), F.sum(k).alias("total"))


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls by tool, from the JSON of their messages, and how many do not parse."""
    e = table(spark, sf_dir, "agent_event").where("event_type = 'TOOL_CALL'").select("event_id", F.get_json_object("message", "$.tool").alias("tool")).distinct()
    return e.groupBy(F.coalesce("tool", F.lit("")).alias("tool")).agg(F.count("*").alias("calls"))


QUERIES = {
    f.__name__: f
    for f in (
        event_replay, dedup_first, latest_n_detail, running_budget, greedy_batches, greedy_chunks, stream_tumbling, stream_sliding,
        stream_session, stream_dedup, json_extract, tool_calls,
    )
}

SQL = {
    "event_replay": f"""with e as (select distinct on (event_id) task_id, event_id, agent_type, event_type, length(substring(message, 1, {S.MESSAGE_LIMIT})) as characters from agent_event)
      select task_id, row_number() over (partition by task_id order by event_id) as place, event_id, agent_type, event_type, characters from e""",
    "dedup_first": "select task_id, agent_type, event_type, min(event_id) as event_id from agent_event group by all",
    "latest_n_detail": """with e as (select task_id, event_id, max(length(message)) as n from agent_event where event_type = 'OBSERVATION' and message is not null group by 1, 2),
      r as (select *, row_number() over (partition by task_id order by event_id desc) as place from e),
      s as (select *, case when place <= 3 then n else least(n, 80) end as shown from r),
      b as (select *, coalesce(sum(shown) over (partition by task_id order by event_id desc rows between unbounded preceding and 1 preceding), 0) as before from s)
      select task_id, event_id, place, least(shown, 6000 - before)::bigint as shown from b where least(shown, 6000 - before) > 0""",
    "running_budget": """with b as (select source, doc_id, n_chars, coalesce(sum(n_chars) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) as before from documents)
      select source, doc_id, greatest(0, least(n_chars, 200000 - before))::bigint as used from b where greatest(0, least(n_chars, 200000 - before)) > 0""",
    "greedy_batches": """with recursive u as (select task_id, id, size, row_number() over (partition by task_id order by id) as k from (select task_id, id, max(length(content)) + 1000 as size from code_chunk where analysis_scope = 'CHANGED' and task_id is not null group by 1, 2)),
      w as (select task_id, id, size, k, 1 as batch, 1 as n, size as total from u where k = 1 union all
        select u.task_id, u.id, u.size, u.k, case when w.n + 1 > 10 or w.total + u.size > 60000 then w.batch + 1 else w.batch end, case when w.n + 1 > 10 or w.total + u.size > 60000 then 1 else w.n + 1 end,
          case when w.n + 1 > 10 or w.total + u.size > 60000 then u.size else w.total + u.size end from w join u on u.task_id = w.task_id and u.k = w.k + 1)
      select task_id, id, size, batch from w""",
    "greedy_chunks": f"""with recursive l as materialized (select id, i, length(x) + 1 as size from (select id, unnest(r) as x, generate_subscripts(r, 1) as i from (select distinct id, {_LINES} as r from code_chunk where content is not null))),
      w as (select id, i, 1 as first, size as chars, 1 as n from l where i = 1 union all
        select l.id, l.i, case when f then l.i else w.first end, case when f then l.size else w.chars + l.size end, case when f then 1 else w.n + 1 end
        from w join l on l.id = w.id and l.i = w.i + 1, lateral (select w.n + 1 > 160 or w.chars + l.size > 12000 as f) t)
      select id, first::int as first, max(i)::int as "end", max(chars)::int as chars from w group by id, first""",
    "stream_tumbling": "select epoch_us(date_trunc('hour', ts)) as window_start, event_type, count(*) as events, round(sum(value), 2) as total from events group by 1, 2",
    "stream_sliding": "select epoch_us(date_trunc('hour', ts) - to_hours(k)) as window_start, event_type, count(*) as events, round(sum(value), 2) as total from events, (values (0), (1)) t(k) group by 1, 2",
    "stream_session": """with g as (select *, case when ts < lag(ts) over w + interval 30 minutes then 0 else 1 end as fresh from events window w as (partition by user_id order by ts)),
      s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as n from g)
      select user_id, epoch_us(min(ts)) as session_start, count(*) as events from s group by user_id, n""",
    "stream_dedup": "select distinct on (event_id) event_id, user_id, event_type from events",
    "json_extract": "select event_type, (props ->> '$.k')::int % 10 as bucket, count(*) as events, sum((props ->> '$.k')::int)::bigint as total from events group by 1, 2",
    "tool_calls": "select coalesce(tool, '') as tool, count(*) as calls from (select distinct event_id, case when json_valid(message) then message ->> '$.tool' end as tool from agent_event where event_type = 'TOOL_CALL') group by 1",
}
