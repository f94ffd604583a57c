"""Registered analytic queries and their oracles."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import numbers as N
from plumbline.functions import semi
from plumbline.operators import analytics as A
from plumbline.operators import trailing
from plumbline.sources import shards
from plumbline.sources.tables import derive, load, plain

END_DAY = "2024-01-30"


def shard_union_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven day shards up to the end day, read as one input."""
    events = load(spark, sf_dir, "events")
    week = events.filter(shards.trailing_days(F.col("ts"), END_DAY, 7))
    return (
        week.withColumn("shard", shards.day_shard(F.col("ts")))
        .groupBy("shard")
        .agg(
            F.count(F.lit(1)).alias("n_events"),
            F.round(F.sum("value"), 2).alias("total_value"),
        )
    )


SHARD_UNION_COUNTS_SQL = " union all ".join(
    f"""select '202401{d}' as shard, count(*) as n_events, round(sum(value), 2) as total_value
    from events where strftime(ts, '%Y%m%d') = '202401{d}' having count(*) > 0"""
    for d in range(24, 31)
)

# Parameters as they come: an object with k, an empty object, no JSON at all, or NULL.
OBJECT = """case when event_id % 5 = 0 then '{{}}' when event_id % 23 = 0 then 'none'
            when event_id % 7 = 0 then null else props end"""
PROPS = "select event_id, event_type, value, " + OBJECT + " as params from {events}"


def json_path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows where a path is or is not NULL, on an object and on an array around it."""
    rows = derive(spark, sf_dir, PROPS)
    listed = F.concat(F.lit("["), F.col("params"), F.lit("]"))
    found = rows.select(
        "event_type",
        semi.path(F.col("params"), "$.k", "int").alias("k"),
        semi.path(listed, "$.k", "int").alias("k_on_array"),
        semi.path(listed, "$[0].k", "int").alias("k_in_array"),
    )
    return found.groupBy("event_type").agg(
        F.count_if(F.col("k").isNotNull()).alias("with_k"),
        F.count_if(F.col("k").isNull()).alias("without_k"),
        F.count("k_on_array").alias("with_k_on_array"),
        F.count("k_in_array").alias("with_k_in_array"),
        F.sum("k").alias("sum_k"),
    )


JSON_PATH_FILTER_SQL = (
    """
with rows as (select event_type, case when json_valid(params) then params end as params from ("""
    + PROPS.replace("{{}}", "{}").replace("{events}", "events")
    + """)),
found as (select event_type, cast(json_extract(params, '$.k') as integer) as k,
                 cast(json_extract('[' || params || ']', '$.k') as integer) as k_on_array,
                 cast(json_extract('[' || params || ']', '$[0].k') as integer) as k_in_array
          from rows)
select event_type, count(k) as with_k, count(*) - count(k) as without_k,
       count(k_on_array) as with_k_on_array, count(k_in_array) as with_k_in_array,
       cast(sum(k) as bigint) as sum_k
from found group by event_type
"""
)

# Parameter lists: a rising number of key/value pairs, some of them empty or NULL.
PARAMETERS = """
select event_id, user_id, event_type,
       case event_id % 6
         when 0 then '[]'
         when 1 then null
         when 2 then '[{{"key": "k", "value": {{"int_value": ' || cast(event_id % 100 as string) || '}}}}]'
         when 3 then '[{{"key": "engaged_' || event_type || '", "value": {{"int_value": '
              || cast(user_id as string) || '}}}}, {{"key": "page", "value": {{"string_value": "p'
              || cast(event_id % 9 as string) || '"}}}}]'
         else '[{{"key": "engagement_time_msec", "value": {{"int_value": '
              || cast(event_id * 3 as string) || '}}}}, {{"key": "k", "value": {{}}}}, '
              || '{{"key": "Engage", "value": {{"string_value": "x"}}}}]'
       end as params
from {events}
"""
# Both shapes of parameters from one scan.
BOTH_KINDS = PARAMETERS.replace("end as params", "end as params, " + OBJECT + " as object")
PARAMETERS_PLAIN = PARAMETERS.replace("{{", "{").replace("}}", "}").replace("{events}", "events")


def json_keys_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct keys of the objects, and of the parameter lists where they match a pattern."""
    both = derive(spark, sf_dir, BOTH_KINDS)
    listed = F.filter(
        semi.parameter_keys(F.col("params")), lambda k: F.ilike(k, F.lit("%engage%"))
    )
    found = both.select(
        F.explode(
            F.concat(
                _tagged("object", semi.object_keys(F.col("object"))), _tagged("list", listed)
            )
        ).alias("found")
    )
    return found.select("found.source", "found.key").distinct()


def _tagged(source: str, keys: Column) -> Column:
    tagged = F.transform(keys, lambda k: F.struct(F.lit(source).alias("source"), k.alias("key")))
    return F.coalesce(tagged, F.array().cast("array<struct<source: string, key: string>>"))


JSON_KEYS_DISTINCT_SQL = (
    """
select distinct 'object' as source, unnest(json_keys(params)) as key
from (select case when json_valid(params) then params end as params from ("""
    + PROPS.replace("{{}}", "{}").replace("{events}", "events")
    + """))
union
select distinct 'list', key from (
  select json_extract_string(e, '$.key') as key
  from (select unnest(cast(params as json[])) as e from ("""
    + PARAMETERS_PLAIN
    + """))) where key ilike '%engage%'
"""
)


def flatten_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per parameter with its integer value; events without any keep one row."""
    rows = semi.parameters(derive(spark, sf_dir, PARAMETERS), "params", keep_empty=True)
    return rows.select(
        "event_id",
        "key",
        F.col("value.int_value").alias("int_value"),
        F.col("value.string_value").alias("string_value"),
    )


FLATTEN_PARAMS_SQL = (
    """
with p as ("""
    + PARAMETERS_PLAIN
    + """),
flat as (select event_id, unnest(cast(params as json[])) as e from p)
select event_id, json_extract_string(e, '$.key') as key,
       cast(json_extract(e, '$.value.int_value') as bigint) as int_value,
       json_extract_string(e, '$.value.string_value') as string_value
from flat
union all
select event_id, null, null, null from p where params is null or params = '[]'
"""
)


def _user_flags(spark: SparkSession, sf_dir: str, short_type: str) -> DataFrame:
    ts, kind = F.col("ts"), F.col("event_type")
    return A.flags_per_key(
        load(spark, sf_dir, "events"),
        "user_id",
        {
            "in_week": (kind == "purchase") & shards.trailing_days(ts, END_DAY, 7),
            "in_two_days": (kind == short_type) & shards.trailing_days(ts, END_DAY, 2),
        },
    )


def active_users_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    active = events.filter(
        shards.trailing_days(F.col("ts"), END_DAY, 7) & (F.col("value") > 10)
    )
    return active.agg(F.count_distinct("user_id").alias("n_users"))


ACTIVE_USERS_SQL = """
select count(distinct user_id) as n_users from events
where ts >= '2024-01-24' and ts < '2024-01-31' and value > 10
"""


def users_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with a purchase in the week and an error in its last two days."""
    return A.in_all(_user_flags(spark, sf_dir, "error"), "user_id", "in_week", "in_two_days")


def users_lapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with a purchase in the week but none in its last two days."""
    flags = _user_flags(spark, sf_dir, "purchase")
    return A.in_first_only(flags, "user_id", "in_week", "in_two_days")


def user_set_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the two-input INTERSECT and difference, for inputs that share no scan."""
    buyers = load(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    buyers = buyers.select(F.col("o_custkey").alias("id"))
    users = load(spark, sf_dir, "events").filter("event_type = 'signup'")
    users = users.select(F.col("user_id").alias("id"))
    return A.set_counts(buyers, users, "id").select("n_ids", "part")


_WEEK = "event_type = 'purchase' and ts >= '2024-01-24' and ts < '2024-01-31'"
USERS_INTERSECT_SQL = f"""
select user_id from events where {_WEEK}
intersect
select user_id from events where event_type = 'error' and ts >= '2024-01-29' and ts < '2024-01-31'
"""
USERS_LAPSED_SQL = f"""
select user_id from events where {_WEEK}
except
select user_id from events where {_WEEK} and ts >= '2024-01-29'
"""
USER_SET_COUNTS_SQL = """
with b as (select o_custkey as id from orders where o_orderpriority = '1-URGENT'),
u as (select user_id as id from events where event_type = 'signup')
select 'both' as part, count(*) as n_ids from (select id from b intersect select id from u)
union all
select 'first_only', count(*) from (select id from b except select id from u)
"""


def net_balance_topk_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the ten largest net balances.

    Customers pay suppliers for their lines and pay a fee on top; the fee goes to the account
    of the customer's nation. Lines of open status or kind are left out. Lines are summed per
    customer and supplier before customers are looked up.
    """
    orders = load(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'")
    lines = load(spark, sf_dir, "lineitem").filter(
        "l_returnflag NOT IN ('N') AND l_suppkey IS NOT NULL"
    )
    paid = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).selectExpr(
        "o_custkey",
        "l_suppkey",
        "l_extendedprice * (1 - l_discount) AS price",
        "l_extendedprice * l_tax AS fee",
    )
    legs = paid.selectExpr(
        "inline(array("
        "struct('c' AS kind, o_custkey AS id, -price AS amount, fee AS fee),"
        "struct('s' AS kind, l_suppkey AS id, price AS amount, 0D AS fee)))"
    )
    # One struct with copies of the keys: filters on keys, or fields left out, would go below
    # the sums in each of its two uses, and both would read and sum all lines.
    totals = legs.groupBy("kind", "id").agg(
        F.struct(
            F.max("kind").alias("kind"),
            F.max("id").alias("id"),
            F.sum("amount").alias("amount"),
            F.sum("fee").alias("fee"),
        ).alias("own")
    ).select("own")
    # Accounts are unique by now; only the nations' shares of the fees are summed once more.
    accounts = totals.filter("own.id IS NOT NULL").selectExpr("own.amount - own.fee AS balance")
    customers = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    payers = totals.filter("own.kind = 'c'")
    fees = payers.join(customers, F.expr("own.id = c_custkey")).selectExpr("c_nationkey", "own.fee")
    nations = A.signed_totals(fees, {"fees": (F.col("c_nationkey"), F.col("fee"))})
    balances = accounts.unionByName(nations.select("balance"))
    return A.top_mean(balances, "balance", 10, 3, "mean_balance_thousands")


NET_BALANCE_SQL = """
with paid as (
  select o_custkey, l_suppkey, c_nationkey, l_extendedprice * (1 - l_discount) as price,
         l_extendedprice * l_tax as fee
  from lineitem join orders on l_orderkey = o_orderkey
       left join customer on c_custkey = o_custkey
  where o_orderstatus <> 'P' and l_returnflag not in ('N') and l_suppkey is not null),
legs as (
  select 'c' || o_custkey as account, -sum(price) as amount from paid group by 1
  union all select 's' || l_suppkey, sum(price) from paid group by 1
  union all select 'c' || o_custkey, -sum(fee) from paid group by 1
  union all select 'n' || c_nationkey, sum(fee) from paid where c_nationkey is not null group by 1),
net as (select account, sum(amount) as balance from legs group by 1),
top as (select balance from net order by balance desc limit 10)
select round(avg(balance) / power(10, 3), 2) as mean_balance_thousands from top
"""


def fee_by_correlated_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer, quantity of every line times the mean tax of its order, summed.

    The correlated mean is a second aggregate of the same lines, so lines are reduced to one
    row per order before the join.
    """
    per_order = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("quantity"), F.avg("l_tax").alias("mean_tax")
    )
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return (
        orders.join(per_order, orders["o_orderkey"] == per_order["l_orderkey"])
        .groupBy("o_custkey")
        .agg(F.round(F.sum(F.col("quantity") * F.col("mean_tax")), 8).alias("fee"))
    )


FEE_SQL = """
select o_custkey,
  round(sum(l_quantity * (select avg(t.l_tax) from lineitem t where t.l_orderkey = o_orderkey)), 8)
    as fee
from orders join lineitem on o_orderkey = l_orderkey group by o_custkey
"""


def filtered_minmax_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extremes and shares of two flags, in one aggregate over one scan."""
    flag = F.col("l_returnflag")
    return load(spark, sf_dir, "lineitem").filter(flag.isin("A", "R")).agg(
        F.min("l_partkey").alias("min_partkey"),
        F.max("l_partkey").alias("max_partkey"),
        F.round(A.share(flag == "A"), 6).alias("share_a"),
        F.round(A.share(flag == "R"), 6).alias("share_r"),
    )


MINMAX_SHARE_SQL = """
with f as (select * from lineitem where l_returnflag = 'A' or l_returnflag = 'R'),
m as (select min(l_partkey) as min_partkey, max(l_partkey) as max_partkey from f),
p as (select round(sum(case when l_returnflag = 'A' then 1 else 0 end) * 1.0 / count(*), 6) as share_a,
             round(sum(case when l_returnflag = 'R' then 1 else 0 end) * 1.0 / count(*), 6) as share_r
      from f)
select min_partkey, max_partkey, share_a, share_r from m, p
"""


def max_of_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = load(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.sum("l_quantity").alias("quantity")
    )
    return sums.agg(F.max("quantity").alias("max_quantity"))


MAX_OF_SUM_SQL = """
select max(quantity) as max_quantity
from (select sum(l_quantity) as quantity from lineitem group by l_suppkey)
"""


def partition_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with the mean quantity of its return flag."""
    rows = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"
    )
    means = A.mean_per_key(rows, "l_returnflag", "l_quantity", "mean_quantity")
    return means.withColumn("mean_quantity", F.round("mean_quantity", 6))


PARTITION_AVG_SQL = """
select l_orderkey, l_linenumber, l_returnflag, l_quantity,
  round(avg(l_quantity) over (partition by l_returnflag), 6) as mean_quantity
from lineitem
"""

# Customers get coordinates, some of them off the globe.
PLACES = """
select c_custkey, c_custkey * 37 % 400 - 200.0 as lon, c_acctbal / 60.0 - 60.0 as lat
from {customer}
"""


def range_and_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kilometres from a fixed port, for the places that are on the globe."""
    lon, lat = F.col("lon"), F.col("lat")
    places = derive(spark, sf_dir, PLACES).filter(N.is_point(lon, lat))
    metres = N.metres_between(lon, lat, F.lit(4.48), F.lit(51.92))
    return places.select("c_custkey", F.round(metres / 1000, 3).alias("km"))


RANGE_AND_DISTANCE_SQL = plain(
    f"""
select c_custkey, round(2 * 6371000.0 * asin(sqrt(least(1.0,
    power(sin(radians(51.92 - lat) / 2), 2)
    + cos(radians(lat)) * cos(radians(51.92)) * power(sin(radians(4.48 - lon) / 2), 2)))) / 1000, 3)
  as km
from ({PLACES}) where lon between -180 and 180 and lat between -90 and 90
"""
)


def coded_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose date, coded as yyyymmdd, lies in a range; ends included."""
    orders = load(spark, sf_dir, "orders")
    inside = orders.filter(shards.coded_days_between(F.col("o_orderdate"), 19970315, 19980531))
    return inside.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.min(F.date_format("o_orderdate", "yyyyMMdd").cast("int")).alias("first_day"),
        F.max(F.date_format("o_orderdate", "yyyyMMdd").cast("int")).alias("last_day"),
    )


CODED_DATE_RANGE_SQL = """
select o_orderstatus, count(*) as n_orders, min(day) as first_day, max(day) as last_day
from (select o_orderstatus, cast(strftime(o_orderdate, '%Y%m%d') as integer) as day from orders)
where day between 19970315 and 19980531 group by o_orderstatus
"""


def _checked_orders(spark: SparkSession, sf_dir: str) -> tuple:
    """Orders, tests on them, and the join with customers of one segment."""
    orders = load(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice"
    )
    buildings = load(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'")
    tests = {
        "status_open": F.col("o_orderstatus") == "O",
        "priority_exact": F.col("o_orderpriority") == "1-urgent",
        "priority_any_case": F.upper("o_orderpriority") == F.upper(F.lit("1-urgent")),
        "price_high": F.col("o_totalprice") > 200000,
    }
    return orders, tests, "o_custkey", buildings, "c_custkey"


def predicate_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which filter or join removes the rows: each one alone, then all together."""
    return A.survival(*_checked_orders(spark, sf_dir))


def predicate_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every set of filters and joins without which rows come through, and the minimal ones."""
    return A.removals(*_checked_orders(spark, sf_dir))


_SURVIVAL_TESTS = {
    "all_rows": "true",
    "status_open": "o_orderstatus = 'O'",
    "priority_exact": "o_orderpriority = '1-urgent'",
    "priority_any_case": "upper(o_orderpriority) = upper('1-urgent')",
    "price_high": "o_totalprice > 200000",
    "join_partner": "c_custkey is not null",
    "together": "o_orderstatus = 'O' and o_orderpriority = '1-urgent' and "
    "upper(o_orderpriority) = upper('1-urgent') and o_totalprice > 200000 "
    "and c_custkey is not null",
}
PREDICATE_SURVIVAL_SQL = (
    "with j as (select * from orders left join (select * from customer "
    "where c_mktsegment = 'BUILDING') on o_custkey = c_custkey) "
    + " union all ".join(
        f"select '{name}' as \"check\", count(*) filter ({test}) as n_rows from j"
        for name, test in _SURVIVAL_TESTS.items()
    )
)


_CHECKS = [name for name in _SURVIVAL_TESTS if name not in ("all_rows", "together")]
_FAILED = " + ".join(
    f"case when {_SURVIVAL_TESTS[name]} then 0 else {1 << bit} end" for bit, name in enumerate(_CHECKS)
)
_TAKEN = ", ".join(f"case when s & {1 << bit} <> 0 then '{n}' end" for bit, n in enumerate(_CHECKS))
PREDICATE_REMOVALS_SQL = f"""
with j as (select * from orders left join (select * from customer
  where c_mktsegment = 'BUILDING') on o_custkey = c_custkey),
masks as (select {_FAILED} as m from j),
sets as (select s, count(*) as n_rows from range({1 << len(_CHECKS)}) r(s)
  join masks on (m & s) = m group by s)
select concat_ws(',', {_TAKEN}) as removed, cast(bit_count(s) as integer) as n_removed, n_rows,
  not exists (select 1 from sets t where t.s <> sets.s and (t.s & sets.s) = t.s) as minimal
from sets
"""


def equal_filters_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count of rows that meet two equalities and an exclusion; NULLs never pass."""
    rows = load(spark, sf_dir, "lineitem").filter(
        "l_linestatus = 'F' AND l_linenumber = 2 AND l_returnflag NOT IN ('N', 'X') "
        "AND l_suppkey IS NOT NULL"
    )
    return rows.agg(F.count(F.lit(1)).alias("n_rows"))


EQUAL_FILTERS_SQL = """
select count(*) as n_rows from lineitem
where l_linestatus = 'F' and l_linenumber = 2 and l_returnflag not in ('N', 'X')
  and l_suppkey is not null
"""

LENGTHS = [7, 2]


def trailing_active_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users who bought in the 7 and in the 2 days up to each day of a month."""
    events = load(spark, sf_dir, "events").filter(F.col("event_type") == "purchase")
    days = date(2024, 1, 1), date.fromisoformat(END_DAY)
    counts = trailing.trailing_distinct(events, F.col("user_id"), F.col("ts"), *days, LENGTHS)
    return counts.withColumnRenamed("n_keys", "n_users")


TRAILING_SQL = f"""
select cast(e.d as date) as end_day, n.days, count(distinct user_id) as n_users
from range(date '2024-01-01', date '{END_DAY}' + 1, interval 1 day) e(d)
cross join (values (7), (2)) n(days)
left join events on event_type = 'purchase' and ts < e.d + interval 1 day
  and ts >= e.d - to_days(n.days - 1)
group by e.d, n.days
"""

QUERIES = {
    "shard_union_counts": shard_union_counts,
    "json_path_filter": json_path_filter,
    "json_keys_distinct": json_keys_distinct,
    "flatten_params": flatten_params,
    "active_users_distinct": active_users_distinct,
    "trailing_active_users": trailing_active_users,
    "users_intersect": users_intersect,
    "users_lapsed": users_lapsed,
    "user_set_counts": user_set_counts,
    "net_balance_topk_avg": net_balance_topk_avg,
    "fee_by_correlated_avg": fee_by_correlated_avg,
    "filtered_minmax_share": filtered_minmax_share,
    "max_of_sum": max_of_sum,
    "partition_avg": partition_avg,
    "range_and_distance": range_and_distance,
    "coded_date_range": coded_date_range,
    "predicate_survival": predicate_survival,
    "predicate_removals": predicate_removals,
    "equal_filters_count": equal_filters_count,
}
ORACLES = {
    "shard_union_counts": SHARD_UNION_COUNTS_SQL,
    "json_path_filter": JSON_PATH_FILTER_SQL,
    "json_keys_distinct": JSON_KEYS_DISTINCT_SQL,
    "flatten_params": FLATTEN_PARAMS_SQL,
    "active_users_distinct": ACTIVE_USERS_SQL,
    "trailing_active_users": TRAILING_SQL,
    "users_intersect": USERS_INTERSECT_SQL,
    "users_lapsed": USERS_LAPSED_SQL,
    "user_set_counts": USER_SET_COUNTS_SQL,
    "net_balance_topk_avg": NET_BALANCE_SQL,
    "fee_by_correlated_avg": FEE_SQL,
    "filtered_minmax_share": MINMAX_SHARE_SQL,
    "max_of_sum": MAX_OF_SUM_SQL,
    "partition_avg": PARTITION_AVG_SQL,
    "range_and_distance": RANGE_AND_DISTANCE_SQL,
    "coded_date_range": CODED_DATE_RANGE_SQL,
    "predicate_survival": PREDICATE_SURVIVAL_SQL,
    "predicate_removals": PREDICATE_REMOVALS_SQL,
    "equal_filters_count": EQUAL_FILTERS_SQL,
}
