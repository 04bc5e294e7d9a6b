"""Registered warehouse shapes, bound to the given tables.

Money is DECIMAL inside and a double at the edge; dates leave as text, so both
engines of the comparison print them alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import tsql
from gleaner.operators import ordered, warehouse
from gleaner.operators.warehouse import MONEY
from gleaner.sources.tables import Tables

ORDERS_AS_OF = "2001-01-01"
LEDGER_CUTOFF = "2024-01-15"
OVERDUE_AS_OF = "2024-02-29"
RECENT = "2001-11-01"

# (code, entity, name, is_active): fixed reference rows.
STATUS_NAMES = [
    ("F", "ORDER", "Fulfilled", True),
    ("O", "ORDER", "Open", True),
    ("P", "ORDER", "Pending", False),
    ("F", "LINE", "Finished", True),
    ("O", "LINE", "Outstanding", True),
    ("ACTIVE", "CUSTOMER", "Active", True),
]


def status_names(spark) -> DataFrame:
    return spark.createDataFrame(STATUS_NAMES, "code string, entity string, name string, is_active boolean")


def money(column) -> Column:
    return F.col(column).cast(MONEY)


def day(column) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


def instant(column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def number(column, name=None) -> Column:
    return F.col(column).cast("double").alias(name or column)


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def signed_events(t: Tables) -> DataFrame:
    """Events as ledger postings: purchases take away, everything else adds."""
    amount = F.when(F.col("event_type") == "purchase", -money("value")).otherwise(money("value"))
    return t.events.select("event_id", "ts", "user_id", "event_type", amount.cast(MONEY).alias("amount"))


def events_ledger(t: Tables) -> DataFrame:
    return ordered.running_total(signed_events(t), "user_id", ["ts", "event_id"], "amount", chunk=F.to_date("ts"))


def events_history(t: Tables) -> DataFrame:
    return warehouse.validity_history(
        t.events, "user_id", "ts", "event_id", "event_type", chunk=F.to_date("effective")
    )


def events_current(t: Tables) -> DataFrame:
    return warehouse.current_states(t.events, "user_id", "ts", "event_id", "event_type")


def latest_per_entity(spark, folder):
    t = Tables(spark, folder)
    rows = ordered.latest_rows(
        t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderdate", "o_totalprice"]
    )
    return rows.select("o_custkey", "o_orderkey", day("o_orderdate").alias("o_orderdate"), "o_totalprice")


def ledger_as_of(spark, folder):
    postings = signed_events(Tables(spark, folder))
    rows = warehouse.balance_as_of(postings, "user_id", "ts", "event_id", "amount", ntz(LEDGER_CUTOFF))
    return rows.select("user_id", "event_id", number("balance"))


def period_over_period(spark, folder):
    rows = warehouse.period_change(events_ledger(Tables(spark, folder)), "user_id", "ts", "event_id", "balance")
    return rows.select("user_id", day("period_end").alias("period_end"), number("balance"), number("change"))


def fanout_safe_join(spark, folder):
    """Order value by priority from one row per order, next to the double-counted value of a plain join."""
    t = Tables(spark, folder)
    joined = warehouse.with_child_totals(
        t.orders.select("o_orderkey", "o_orderpriority", money("o_totalprice").alias("price")),
        "o_orderkey",
        t.lineitem,
        "l_orderkey",
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(money("l_extendedprice")).alias("lines_price"),
    )
    # An inner join would repeat an order once per line: its price times its line count.
    repeated = F.col("price") * F.coalesce("n_lines", F.lit(0))
    return joined.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.coalesce(F.sum("n_lines"), F.lit(0)).alias("n_lines"),
        F.sum("price").cast("double").alias("order_value"),
        F.sum("lines_price").cast("double").alias("line_value"),
        F.sum(repeated).cast("double").alias("double_counted_value"),
    )


def scd2_current(spark, folder):
    rows = events_current(Tables(spark, folder))
    return rows.select("user_id", "event_id", instant("effective").alias("effective"), "state")


def scd2_one_current(spark, folder):
    """Users without exactly one current row; none is the healthy answer, so the tally is kept too."""
    per_user = events_history(Tables(spark, folder)).groupBy("user_id").agg(
        F.count_if(F.col("ended").isNull()).alias("n_current")
    )
    return per_user.groupBy("n_current").agg(F.count(F.lit(1)).alias("n_users"))


def aging_buckets(spark, folder):
    t = Tables(spark, folder)
    days = F.datediff(F.to_date(F.lit(ORDERS_AS_OF)), F.to_date("l_shipdate"))
    return t.lineitem.where(F.col("l_linestatus") == "O").groupBy(
        warehouse.age_bucket(days).alias("bucket")
    ).agg(F.count(F.lit(1)).alias("n_lines"), F.sum(money("l_extendedprice")).cast("double").alias("amount"))


def overdue_current(spark, folder):
    """Users whose current state has lasted 30 days or more."""
    rows = events_current(Tables(spark, folder))
    days = F.datediff(F.to_date(F.lit(OVERDUE_AS_OF)), F.to_date("effective")).cast("long")
    return rows.withColumn("days_in_state", days).where(F.col("days_in_state") >= 30).select(
        "user_id", "state", "days_in_state"
    )


def composite_lookup(spark, folder):
    """Codes O and F mean different things for orders and for lines: the entity is part of the key."""
    t = Tables(spark, folder)
    names = F.broadcast(status_names(spark))
    coded = (
        t.orders.groupBy(F.col("o_orderstatus").alias("code"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("entity", F.lit("ORDER"))
        .unionByName(
            t.lineitem.groupBy(F.col("l_linestatus").alias("code"))
            .agg(F.count(F.lit(1)).alias("n_rows"))
            .withColumn("entity", F.lit("LINE"))
        )
    )
    return coded.join(names, ["code", "entity"]).select("entity", "code", "name", "n_rows")


def code_lookup(spark, folder):
    t = Tables(spark, folder)
    nations = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return t.customer.join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        "c_custkey", "c_name", "n_name", "r_name"
    )


def multi_hop_rolling(spark, folder):
    """Lines of the last 30 days by the suppliers' nation: lineitem, supplier, nation."""
    t = Tables(spark, folder)
    recent = t.lineitem.where(
        (F.col("l_shipdate") > ntz(RECENT) - F.expr("INTERVAL 30 DAYS")) & (F.col("l_shipdate") <= ntz(RECENT))
    )
    by_supplier = recent.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(money("l_extendedprice")).alias("amount")
    )
    hops = by_supplier.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(
        t.nation, F.col("s_nationkey") == F.col("n_nationkey")
    )
    return hops.where(F.col("n_name").endswith("1")).groupBy("n_name").agg(
        F.sum("n_lines").alias("n_lines"), F.sum("amount").cast("double").alias("amount")
    )


def hub_join_latest(spark, folder):
    """Each customer with the latest order and that order's line totals."""
    t = Tables(spark, folder)
    newest = ordered.latest_rows(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus"])
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(money("l_quantity")).alias("quantity")
    )
    return (
        t.customer.join(newest, F.col("c_custkey") == F.col("o_custkey"))
        .join(lines, "o_orderkey", "left")
        .select(
            "c_custkey", "c_name", "o_orderkey", "o_orderstatus",
            F.coalesce("n_lines", F.lit(0)).alias("n_lines"),
            F.coalesce(F.col("quantity"), F.lit(0)).cast("double").alias("quantity"),
        )
    )


def self_join_roles(spark, folder):
    """Household heads and members: four neighbouring customer keys are one household."""
    customer = Tables(spark, folder).customer
    member = customer.select(
        F.col("c_custkey").alias("member_key"), F.col("c_name").alias("member_name"),
        (F.col("c_custkey") - F.col("c_custkey") % 4).alias("head_key"),
    ).where(F.col("member_key") != F.col("head_key"))
    head = customer.select(F.col("c_custkey").alias("head_key"), F.col("c_name").alias("head_name"))
    return member.join(head, "head_key")


def unmatched_parents(spark, folder):
    """Parts never ordered with a discount of 10 %, and their share of all parts of the brand."""
    t = Tables(spark, folder)
    sold = t.lineitem.where(F.col("l_discount") >= 0.1).select(F.col("l_partkey").alias("p_partkey")).distinct()
    flagged = t.part.join(sold.withColumn("sold", F.lit(1)), "p_partkey", "left")
    return flagged.groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("n_parts"),
        F.count_if(F.col("sold").isNull()).alias("n_unmatched"),
        F.round(F.count_if(F.col("sold").isNull()) / F.count(F.lit(1)), 6).alias("share"),
    )


def has_child(spark, folder):
    t = Tables(spark, folder)
    keys = t.orders.where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(keys, "c_custkey", "left_semi").select("c_custkey", "c_name")


def reconcile_parent_child(spark, folder):
    """Orders whose total is not the sum of their lines' net prices (to 10 %)."""
    t = Tables(spark, folder)
    net = (money("l_extendedprice") * (1 - money("l_discount"))).cast(MONEY)
    rows = warehouse.reconcile(
        t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", money("o_totalprice"),
        t.lineitem, "l_orderkey", net, money("o_totalprice") * F.lit("0.10").cast(MONEY),
    )
    return rows.select("o_orderkey", number("expected"), number("child_sum"))


def missed_as_of(spark, folder):
    t = Tables(spark, folder)
    due = t.lineitem.where((F.col("l_linestatus") == "O") & (F.col("l_shipdate") < ntz(ORDERS_AS_OF)))
    return due.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_missed"), day(F.min("l_shipdate")).alias("first_due")
    )


def row_identity(spark, folder):
    """Lines where rounded net and rounded discount do not add up to the price."""
    price, rate = money("l_extendedprice"), money("l_discount")
    net, off = F.round(price * (1 - rate), 1), F.round(price * rate, 1)
    lines = Tables(spark, folder).lineitem.select("l_orderkey", "l_partkey", price.alias("price"), net.alias("net"), off.alias("off"))
    return lines.where(F.col("price") != F.col("net") + F.col("off")).select(
        "l_orderkey", "l_partkey", number("price"), number("net"), number("off")
    )


def signed_amount(spark, folder):
    return signed_events(Tables(spark, folder)).select("event_id", "user_id", number("amount"))


def running_balance(spark, folder):
    return events_ledger(Tables(spark, folder)).select("event_id", "user_id", number("amount"), number("balance"))


def conditional_accrual(spark, folder):
    points = F.when(F.col("event_type") == "purchase", F.floor("value")).otherwise(F.lit(0))
    return Tables(spark, folder).events.groupBy("user_id").agg(
        F.sum(points).cast("long").alias("points"), F.count(F.lit(1)).alias("n_events")
    )


def calendar_range(spark, folder):
    rows = Tables(spark, folder).orders.where(
        (F.col("o_orderdate") >= ntz("1997-01-01")) & (F.col("o_orderdate") < ntz("1998-01-01"))
    )
    return rows.select("o_orderkey", "o_custkey", day("o_orderdate").alias("o_orderdate"))


def rolling_year_count(spark, folder):
    today = F.to_date(F.lit(ORDERS_AS_OF))
    orders = Tables(spark, folder).orders.where(
        (F.col("o_orderdate") > tsql.dateadd("year", -1, today)) & (F.col("o_orderdate") <= today)
    )
    return orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_orders"))


def count_by_year(spark, folder):
    year = F.year("o_orderdate").cast("long").alias("year")
    return Tables(spark, folder).orders.groupBy(year).agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum(money("o_totalprice")).cast("double").alias("value")
    )


def _page(spark, folder, skip: int, take: int):
    orders = Tables(spark, folder).orders.orderBy(F.desc("o_totalprice"), "o_orderkey")
    return orders.offset(skip).limit(take).select("o_orderkey", "o_totalprice")


def top_n(spark, folder):
    orders = Tables(spark, folder).orders.orderBy(F.desc("o_totalprice"), "o_orderkey")
    return orders.limit(10).select("o_orderkey", "o_totalprice")


def page_offset_fetch(spark, folder):
    return _page(spark, folder, 20, 10)


def lead_lag(spark, folder):
    rows = ordered.neighbours(
        Tables(spark, folder).events.select("event_id", "user_id", "ts", "value"),
        "user_id", ["ts", "event_id"], chunk=F.to_date("ts"),
        following={"next_value": "value"}, preceding={"previous_value": "value"},
    )
    return rows.select("event_id", "user_id", "value", "next_value", "previous_value")


def share_of_total(spark, folder):
    lines = Tables(spark, folder).lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", money("l_extendedprice").alias("price")
    )
    rows = warehouse.share_of_total(lines, "l_orderkey", F.col("price"))
    return rows.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(F.col("share").cast("double"), 6).alias("share")
    )


def active_codes_filter(spark, folder):
    names = status_names(spark).where((F.col("entity") == "ORDER") & F.col("is_active"))
    orders = Tables(spark, folder).orders
    return orders.join(F.broadcast(names), F.col("o_orderstatus") == F.col("code"), "left_semi").select(
        "o_orderkey", "o_orderstatus"
    )


def component_split(spark, folder):
    price, rate, tax = money("l_extendedprice"), money("l_discount"), money("l_tax")
    return Tables(spark, folder).lineitem.groupBy("l_orderkey").agg(
        F.sum(price).cast("double").alias("gross"),
        F.sum(price * rate).cast("double").alias("discount"),
        F.sum(price * (1 - rate) * tax).cast("double").alias("tax"),
    )


def null_as_state(spark, folder):
    decided = F.when(F.col("ended").isNull(), "pending").otherwise("decided")
    return events_history(Tables(spark, folder)).groupBy(decided.alias("decision"), "state").agg(
        F.count(F.lit(1)).alias("n_rows")
    )


def open_children_detail(spark, folder):
    t = Tables(spark, folder)
    return (
        t.orders.where(F.col("o_orderstatus") == "O")
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("o_orderkey", "c_name", "c_mktsegment", "n_name", "o_totalprice", "c_acctbal")
    )


def tsql_date_functions(spark, folder):
    today, placed = F.to_date(F.lit(ORDERS_AS_OF)), F.to_date("o_orderdate")
    return Tables(spark, folder).orders.select(
        "o_orderkey",
        day(tsql.eomonth(placed)).alias("month_end"),
        day(tsql.dateadd("month", 1, placed)).alias("next_month"),
        day(tsql.dateadd("day", -7, placed)).alias("week_before"),
        tsql.datediff("year", placed, today).cast("long").alias("years"),
        tsql.datediff("quarter", placed, today).cast("long").alias("quarters"),
        tsql.datediff("month", placed, today).cast("long").alias("months"),
        tsql.datediff("day", placed, today).cast("long").alias("days"),
        day(tsql.datefromparts(F.year(placed), F.month(placed), F.lit(1))).alias("month_start"),
        tsql.isnull(F.nullif(F.col("o_orderstatus"), F.lit("P")), F.lit("?")).alias("status"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        latest_per_entity, ledger_as_of, period_over_period, fanout_safe_join, scd2_current, scd2_one_current,
        aging_buckets, overdue_current, composite_lookup, code_lookup, multi_hop_rolling, hub_join_latest,
        self_join_roles, unmatched_parents, has_child, reconcile_parent_child, missed_as_of, row_identity,
        signed_amount, running_balance, conditional_accrual, calendar_range, rolling_year_count, count_by_year,
        top_n, page_offset_fetch, lead_lag, share_of_total, active_codes_filter, component_split, null_as_state,
        open_children_detail, tsql_date_functions,
    )
}

_LEDGER = """WITH signed AS (
  SELECT event_id, ts, user_id,
    (CASE WHEN event_type = 'purchase' THEN -(value::DECIMAL(15,2)) ELSE value::DECIMAL(15,2) END) AS amount FROM events
), ledger AS (SELECT *, sum(amount) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS balance FROM signed)"""
_HISTORY = """WITH history AS (
  SELECT user_id, event_id, ts AS effective, event_type AS state,
    lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ended FROM events
)"""
_STATUS = """(VALUES ('F','ORDER','Fulfilled',true),('O','ORDER','Open',true),('P','ORDER','Pending',false),
  ('F','LINE','Finished',true),('O','LINE','Outstanding',true),('ACTIVE','CUSTOMER','Active',true)
) AS s(code, entity, name, is_active)"""

ORACLES = {
    "latest_per_entity": """SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_totalprice
        FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
    "ledger_as_of": _LEDGER + f""" SELECT user_id, event_id, balance::DOUBLE AS balance FROM ledger
        WHERE ts <= TIMESTAMP '{LEDGER_CUTOFF} 00:00:00'
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "period_over_period": _LEDGER + """, closing AS (
        SELECT user_id, last_day(ts) AS period_end, balance FROM ledger
        QUALIFY row_number() OVER (PARTITION BY user_id, last_day(ts) ORDER BY ts DESC, event_id DESC) = 1)
        SELECT user_id, strftime(period_end, '%Y-%m-%d') AS period_end, balance::DOUBLE AS balance,
          (balance - lag(balance) OVER (PARTITION BY user_id ORDER BY period_end))::DOUBLE AS change FROM closing""",
    "fanout_safe_join": """WITH lines AS (
        SELECT l_orderkey, count(*) AS n, sum(l_extendedprice::DECIMAL(15,2)) AS price FROM lineitem GROUP BY 1
      ), doubled AS (
        SELECT o_orderpriority, sum(o_totalprice::DECIMAL(15,2)) AS v FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
      SELECT o_orderpriority, count(*) AS n_orders, coalesce(sum(n), 0)::BIGINT AS n_lines,
        sum(o_totalprice::DECIMAL(15,2))::DOUBLE AS order_value, sum(price)::DOUBLE AS line_value,
        any_value(v)::DOUBLE AS double_counted_value
      FROM orders LEFT JOIN lines ON l_orderkey = o_orderkey LEFT JOIN doubled USING (o_orderpriority) GROUP BY 1""",
    "scd2_current": _HISTORY + """ SELECT user_id, event_id, strftime(effective, '%Y-%m-%d %H:%M:%S.%f') AS effective, state
        FROM history WHERE ended IS NULL""",
    "scd2_one_current": _HISTORY + """ SELECT n_current, count(*) AS n_users FROM (
        SELECT user_id, count(*) FILTER (WHERE ended IS NULL) AS n_current FROM history GROUP BY 1) GROUP BY 1""",
    "aging_buckets": f"""SELECT CASE WHEN d <= 0 THEN '0' WHEN d < 30 THEN '1-29' WHEN d < 60 THEN '30-59'
          WHEN d < 90 THEN '60-89' ELSE '90+' END AS bucket, count(*) AS n_lines, sum(p)::DOUBLE AS amount
        FROM (SELECT DATE '{ORDERS_AS_OF}' - l_shipdate::DATE AS d, l_extendedprice::DECIMAL(15,2) AS p
              FROM lineitem WHERE l_linestatus = 'O') GROUP BY 1""",
    "overdue_current": _HISTORY + f""" SELECT user_id, state, (DATE '{OVERDUE_AS_OF}' - effective::DATE)::BIGINT AS days_in_state
        FROM history WHERE ended IS NULL AND DATE '{OVERDUE_AS_OF}' - effective::DATE >= 30""",
    "composite_lookup": f"""SELECT entity, code, name, n_rows FROM (
        SELECT o_orderstatus AS code, 'ORDER' AS entity, count(*) AS n_rows FROM orders GROUP BY 1
        UNION ALL SELECT l_linestatus, 'LINE', count(*) FROM lineitem GROUP BY 1) JOIN {_STATUS} USING (code, entity)""",
    "code_lookup": """SELECT c_custkey, c_name, n_name, r_name FROM customer
        LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
    "multi_hop_rolling": f"""SELECT n_name, count(*) AS n_lines, sum(l_extendedprice::DECIMAL(15,2))::DOUBLE AS amount
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
        WHERE l_shipdate > TIMESTAMP '{RECENT} 00:00:00' - INTERVAL 30 DAY AND l_shipdate <= TIMESTAMP '{RECENT} 00:00:00'
          AND n_name LIKE '%1' GROUP BY 1""",
    "hub_join_latest": """WITH newest AS (SELECT * FROM orders
          QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
        SELECT c_custkey, c_name, o_orderkey, o_orderstatus, count(l_orderkey) AS n_lines,
          coalesce(sum(l_quantity::DECIMAL(15,2)), 0)::DOUBLE AS quantity
        FROM customer JOIN newest ON c_custkey = o_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""",
    "self_join_roles": """SELECT m.c_custkey AS member_key, m.c_name AS member_name, h.c_custkey AS head_key, h.c_name AS head_name
        FROM customer m JOIN customer h ON h.c_custkey = m.c_custkey - m.c_custkey % 4 WHERE m.c_custkey <> h.c_custkey""",
    "unmatched_parents": """SELECT p_brand, count(*) AS n_parts, count(*) FILTER (WHERE NOT sold) AS n_unmatched,
          round(count(*) FILTER (WHERE NOT sold) / count(*), 6) AS share
        FROM (SELECT p_brand, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount >= 0.1) AS sold FROM part) GROUP BY 1""",
    "has_child": """SELECT c_custkey, c_name FROM customer
        WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""",
    "reconcile_parent_child": """SELECT o_orderkey, total::DOUBLE AS expected, child_sum::DOUBLE AS child_sum FROM (
          SELECT o_orderkey, o_totalprice::DECIMAL(15,2) AS total, coalesce(s, 0)::DECIMAL(25,2) AS child_sum FROM orders LEFT JOIN (
            SELECT l_orderkey, sum((l_extendedprice::DECIMAL(15,2) * (1 - l_discount::DECIMAL(15,2)))::DECIMAL(15,2)) AS s
            FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)
        WHERE abs(total - child_sum) > total * 0.10""",
    "missed_as_of": f"""SELECT l_orderkey, count(*) AS n_missed, strftime(min(l_shipdate), '%Y-%m-%d') AS first_due FROM lineitem
        WHERE l_linestatus = 'O' AND l_shipdate < TIMESTAMP '{ORDERS_AS_OF} 00:00:00' GROUP BY 1""",
    "row_identity": """SELECT l_orderkey, l_partkey, price::DOUBLE AS price, net::DOUBLE AS net, off::DOUBLE AS "off" FROM (
          SELECT l_orderkey, l_partkey, l_extendedprice::DECIMAL(15,2) AS price,
            round(l_extendedprice::DECIMAL(15,2) * (1 - l_discount::DECIMAL(15,2)), 1) AS net,
            round(l_extendedprice::DECIMAL(15,2) * l_discount::DECIMAL(15,2), 1) AS off FROM lineitem)
        WHERE price <> net + off""",
    "signed_amount": _LEDGER + " SELECT event_id, user_id, amount::DOUBLE AS amount FROM signed",
    "running_balance": _LEDGER + " SELECT event_id, user_id, amount::DOUBLE AS amount, balance::DOUBLE AS balance FROM ledger",
    "conditional_accrual": """SELECT user_id, sum(CASE WHEN event_type = 'purchase' THEN floor(value) ELSE 0 END)::BIGINT AS points,
        count(*) AS n_events FROM events GROUP BY 1""",
    "calendar_range": """SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders
        WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-01-01 00:00:00'""",
    "rolling_year_count": f"""SELECT o_orderstatus, count(*) AS n_orders FROM orders
        WHERE o_orderdate > DATE '{ORDERS_AS_OF}' - INTERVAL 1 YEAR AND o_orderdate <= DATE '{ORDERS_AS_OF}' GROUP BY 1""",
    "count_by_year": """SELECT year(o_orderdate) AS year, count(*) AS n_orders, sum(o_totalprice::DECIMAL(15,2))::DOUBLE AS value
        FROM orders GROUP BY 1""",
    "top_n": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "page_offset_fetch": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 20",
    "lead_lag": """SELECT event_id, user_id, value, lead(value) OVER w AS next_value, lag(value) OVER w AS previous_value
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "share_of_total": """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
          round((p / sum(p) OVER (PARTITION BY l_orderkey))::DOUBLE, 6) AS share
        FROM (SELECT *, l_extendedprice::DECIMAL(15,2) AS p FROM lineitem)""",
    "active_codes_filter": f"""SELECT o_orderkey, o_orderstatus FROM orders
        WHERE o_orderstatus IN (SELECT code FROM {_STATUS} WHERE entity = 'ORDER' AND is_active)""",
    "component_split": """SELECT l_orderkey, sum(p)::DOUBLE AS gross, sum(p * d)::DOUBLE AS discount, sum(p * (1 - d) * x)::DOUBLE AS tax
        FROM (SELECT l_orderkey, l_extendedprice::DECIMAL(15,2) AS p, l_discount::DECIMAL(4,2) AS d, l_tax::DECIMAL(4,2) AS x FROM lineitem)
        GROUP BY 1""",
    "null_as_state": _HISTORY + """ SELECT CASE WHEN ended IS NULL THEN 'pending' ELSE 'decided' END AS decision, state,
        count(*) AS n_rows FROM history GROUP BY ALL""",
    "open_children_detail": """SELECT o_orderkey, c_name, c_mktsegment, n_name, o_totalprice, c_acctbal FROM orders
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'O'""",
    "tsql_date_functions": f"""SELECT o_orderkey, strftime(last_day(d), '%Y-%m-%d') AS month_end,
          strftime(d + INTERVAL 1 MONTH, '%Y-%m-%d') AS next_month, strftime(d - INTERVAL 7 DAY, '%Y-%m-%d') AS week_before,
          date_diff('year', d, t) AS years, date_diff('quarter', d, t) AS quarters, date_diff('month', d, t) AS months,
          date_diff('day', d, t) AS days, strftime(make_date(year(d), month(d), 1), '%Y-%m-%d') AS month_start,
          coalesce(nullif(o_orderstatus, 'P'), '?') AS status
        FROM (SELECT o_orderkey, o_orderstatus, o_orderdate::DATE AS d, DATE '{ORDERS_AS_OF}' AS t FROM orders)""",
}
