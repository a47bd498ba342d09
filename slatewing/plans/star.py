"""Queries on the star tables: joins, ordering, paging and set operators in their plain form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slatewing.session import small_side, table


def equi_two_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines joined with the first line of their order and supplier on two keys."""
    li = table(spark, sf_dir, "lineitem")
    first = li.groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("first_line"), F.count("*").alias("lines"))
    return li.join(first, ["l_orderkey", "l_suppkey"]).where("lines > 1").select("l_orderkey", "l_linenumber", "l_suppkey", "first_line")


def semi_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that have a returned line of more than forty pieces."""
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(li, "o_orderkey", "left_semi").select("o_orderkey", "o_custkey", "o_orderstatus")


def anti_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an urgent order over 200,000."""
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


def nulls_first_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by latest order, those without first; the place within their nation is a column."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("latest"))
    c = table(spark, sf_dir, "customer").join(o, "c_custkey", "left")
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.asc_nulls_first("latest"), F.desc("c_acctbal"), "c_custkey"))
    return c.select("c_custkey", "c_nationkey", "latest", place.alias("place"))


def symbol_search_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best parts for three search words: whole name, beginning of the name, type."""
    name, kind = F.lower("p_name"), F.lower("p_type")
    words = table(spark, sf_dir, "part").select("p_partkey", name.alias("n"), kind.alias("t"))
    score = sum((F.when(F.contains("n", F.lit(w)), 10).otherwise(0) + F.when(F.startswith("n", F.lit(w)), 5).otherwise(0) + F.when(F.contains("t", F.lit(w)), 3).otherwise(0) for w in ("bolt", "red", "small")), F.lit(0))
    found = words.select("p_partkey", score.cast("int").alias("score")).where("score > 0").orderBy(F.desc("score"), "p_partkey").limit(50)
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "p_partkey")))


def cursor_page(spark: SparkSession, sf_dir: str, cursor: int = 40, limit: int = 20) -> DataFrame:
    """One page of parts by price and key, with the cursor of the next."""
    page = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").offset(cursor).limit(limit)
    place = F.row_number().over(Window.orderBy(F.desc("p_retailprice"), "p_partkey")) + cursor
    return page.select("p_partkey", place.cast("int").alias("place"), F.lit(cursor + limit).alias("next_cursor"))


def fallback_nonempty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each brand its large parts, or where it has none its small ones."""
    p = table(spark, sf_dir, "part")
    graded = p.withColumn("grade", F.when(F.col("p_size") >= 50, 1).when(F.col("p_size") <= 5, 2)).where("grade is not null")
    best = F.min("grade").over(Window.partitionBy("p_brand"))
    return graded.withColumn("best", best).where("grade = best").select("p_brand", "p_partkey", "grade")


def set_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and nations by the parts both deal in: how many different part types link them."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return li.join(small_side(p), "l_partkey").join(small_side(s), "l_suppkey").groupBy("s_nationkey", "p_type").agg(F.countDistinct("l_suppkey").alias("suppliers"))


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 0).alias("revenue"),
    )


def order_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their orders' and lines' totals, counted before the joins."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    o = table(spark, sf_dir, "orders").join(li, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.sum("n").alias("lines"))
    c = table(spark, sf_dir, "customer").join(o, "c_custkey", "left")
    return c.select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("lines", F.lit(0)).alias("lines"))


def nearest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of: for each purchase the user's last view before it."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    by = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = e.withColumn("view_id", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(by))
    return seen.where("event_type = 'purchase'").select("event_id", "user_id", "view_id")


QUERIES = {
    f.__name__: f
    for f in (
        equi_two_key_join, semi_scope, anti_customers, nulls_first_order, symbol_search_scored, cursor_page, fallback_nonempty,
        set_overlap_join, pricing_summary, order_summary, nearest_event,
    )
}

_SCORE = " + ".join(f"(case when contains(lower(p_name), '{w}') then 10 else 0 end) + (case when starts_with(lower(p_name), '{w}') then 5 else 0 end) + (case when contains(lower(p_type), '{w}') then 3 else 0 end)" for w in ("bolt", "red", "small"))
SQL = {
    "equi_two_key_join": "with f as (select l_orderkey, l_suppkey, min(l_linenumber) as first_line, count(*) as n from lineitem group by 1, 2) select l.l_orderkey, l_linenumber, l.l_suppkey, first_line from lineitem l join f using (l_orderkey, l_suppkey) where n > 1",
    "semi_scope": "select o_orderkey, o_custkey, o_orderstatus from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R' and l_quantity > 40)",
    "anti_customers": "select c_custkey, c_mktsegment from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT' and o_totalprice > 200000)",
    "nulls_first_order": "select c_custkey, c_nationkey, latest, row_number() over (partition by c_nationkey order by latest asc nulls first, c_acctbal desc, c_custkey) as place from customer left join (select o_custkey, max(o_orderkey) as latest from orders group by 1) on o_custkey = c_custkey",
    "symbol_search_scored": f"select p_partkey, score, row_number() over (order by score desc, p_partkey) as place from (select p_partkey, ({_SCORE})::int as score from part) where score > 0 order by score desc, p_partkey limit 50",
    "cursor_page": "select p_partkey, place::int as place, 60 as next_cursor from (select p_partkey, row_number() over (order by p_retailprice desc, p_partkey) as place from part) where place between 41 and 60",
    "fallback_nonempty": "with g as (select *, case when p_size >= 50 then 1 when p_size <= 5 then 2 end as grade from part), b as (select *, min(grade) over (partition by p_brand) as best from g where grade is not null) select p_brand, p_partkey, grade from b where grade = best",
    "set_overlap_join": "select s_nationkey, p_type, count(distinct l_suppkey) as suppliers from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey group by 1, 2",
    "pricing_summary": "select l_returnflag, l_linestatus, count(*) as lines, round(sum(l_quantity), 2) as quantity, round(avg(l_discount), 6) as discount, round(sum(l_extendedprice * (1 - l_discount)), 0) as revenue from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2",
    "order_summary": "select c_custkey, coalesce(orders, 0) as orders, coalesce(lines, 0)::bigint as lines from customer left join (select o_custkey, count(distinct o_orderkey) as orders, count(l_orderkey) as lines from orders left join lineitem on l_orderkey = o_orderkey group by 1) on o_custkey = c_custkey",
    "nearest_event": "select event_id, user_id, view_id from (select *, last_value(case when event_type = 'view' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as view_id from events) where event_type = 'purchase'",
}
