"""Canonical views of trade-flow analytics over the given tables, in Spark and as SQL text for the oracle.

flows: one swap by one wallet (events); trades: token flows joined with transactions (lineitem); and side tables
for liquidity, metadata, edges, groups, names and market caps. SOL amounts are whole lamports (1e-9), so sums do not
depend on the order of rows; they are divided once, at the end.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LAMPORTS = 1_000_000_000
T0 = 1_704_067_200
#: Rows of a raw table that a task takes.
TASK_ROWS = 250_000


class Tables:
    """Views over sf_dir; nothing is read before it is used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def parts(self, name: str, rows: int = TASK_ROWS) -> int:
        """Partitions of about so many rows of a raw table, those of the session at least. A count given to repartition() stays, as partitions by bytes do not bound the rows of a task."""
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-self.raw(name).count() // rows))

    @cached_property
    def flows(self) -> DataFrame:
        e = self.raw("events").where("value > 0")
        epoch = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
        return e.select(
            (F.col("user_id") % 40).cast("string").alias("wallet"), F.col("event_type").alias("token"),
            (F.lit(T0) + F.floor((epoch - T0) / 120)).cast("long").alias("bt"),
            F.when(F.get_json_object("props", "$.k").cast("int") < 60, "buy").otherwise("sell").alias("direction"),
            F.round(F.col("value") * 0.25 * 1e9).cast("long").alias("lamports"), F.concat(F.lit("sig"), F.col("event_id")).alias("signature"), F.col("event_id").alias("seq"),
        )

    @cached_property
    def trades(self) -> DataFrame:
        l = self.raw("lineitem")  # noqa: E741
        day = F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 1e6
        return l.select(
            F.concat(F.lit("tx"), F.col("l_orderkey"), F.lit("-"), F.col("l_linenumber")).alias("signature"), F.col("l_suppkey").cast("string").alias("wallet"), (F.col("l_partkey") % 200).cast("string").alias("token"),
            (day.cast("long") + (F.col("l_orderkey") * 7919 + F.col("l_linenumber").cast("long") * 104729) % 86400).alias("bt"),
            F.when(F.col("l_returnflag") == "R", "out").otherwise("in").alias("flow_direction"), (F.round(F.col("l_extendedprice") * 100).cast("long") * 10000).alias("lamports"),
            F.element_at(F.array(F.lit("raydium"), F.lit("orca"), F.lit("pump")), (F.col("l_partkey") % 3 + 1).cast("int")).alias("dex"), F.when(F.col("l_linenumber") == 7, "Err").alias("err"),
            F.col("l_quantity").cast("long").alias("units"), F.col("l_orderkey").alias("seq"), F.col("l_linenumber").cast("long").alias("line"),
        )

    @cached_property
    def valid(self) -> DataFrame:
        return self.trades.where("err IS NULL OR err = ''")

    @cached_property
    def mint_liquidity(self) -> DataFrame:
        p = self.raw("part")
        return p.select(F.col("p_partkey").cast("string").alias("token"), F.round(F.col("p_retailprice") * 100).cast("long").alias("liquidity"), (F.col("p_size") % 2).cast("int").alias("lp_lock_flag"), F.col("p_brand").alias("primary_pool"))

    @cached_property
    def mint_metadata(self) -> DataFrame:
        p = self.raw("part")
        flag = lambda n: F.when(F.col("p_size") % n == 0, F.concat(F.lit("auth"), F.col("p_size")))
        return p.select(F.col("p_partkey").cast("string").alias("token"), flag(3).alias("mint_authority"), flag(5).alias("freeze_authority"), (F.col("p_size") % 7 == 0).alias("is_mutable"))

    @cached_property
    def edges(self) -> DataFrame:
        """Wallets of an order in pairs. Numbers are compared as texts and turned to texts at the end; rows are dealt to tasks of a bounded number of them."""
        n = self.parts("lineitem")
        l = self.raw("lineitem").select("l_orderkey", F.col("l_suppkey").alias("w")).repartition(n, "l_orderkey").distinct()  # noqa: E741
        a, b = l.select("l_orderkey", F.col("w").alias("_a")), l.select("l_orderkey", F.col("w").alias("_b"))
        x = a.join(b.hint("merge"), "l_orderkey").where(F.col("_a").cast("string") < F.col("_b").cast("string")).select("_a", "_b")
        x = x.repartition(2 * n, "_a", "_b").groupBy("_a", "_b").agg(F.count("*").alias("weight"))
        return x.select(F.col("_a").cast("string").alias("wallet_a"), F.col("_b").cast("string").alias("wallet_b"), "weight")

    @cached_property
    def members(self) -> DataFrame:
        return self.raw("supplier").select(F.col("s_suppkey").cast("string").alias("wallet"), F.col("s_nationkey").cast("long").alias("group_id"))

    @cached_property
    def names(self) -> DataFrame:
        return self.raw("supplier").select(F.col("s_suppkey").cast("string").alias("address"), F.col("s_name").alias("name"))

    @cached_property
    def mcap(self) -> DataFrame:
        return self.raw("orders").select((F.col("o_custkey") % 200).cast("string").alias("token"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6).cast("long").alias("mcap_time"), F.round(F.col("o_totalprice") * 100).cast("long").alias("mcap"))

    @cached_property
    def liquidity_events(self) -> DataFrame:
        o = self.raw("orders")
        return o.select((F.col("o_custkey") % 200).cast("string").alias("token"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6).cast("long").alias("bt"), F.when(F.col("o_orderstatus") == "F", "remove").otherwise("add").alias("action"), F.round(F.col("o_totalprice") * 100).cast("long").alias("amount"), F.col("o_orderkey").alias("seq"))


    @cached_property
    def holders(self) -> DataFrame:
        """Snapshots at the end of each year: balance of the wallets that traded in it."""
        # dealt once, for the groups and the sums over them
        units = F.when(F.col("flow_direction") == "in", F.col("units")).otherwise(-F.col("units"))
        x = self.valid.select("token", "wallet", F.year(F.timestamp_seconds("bt")).alias("year"), units.alias("units")).repartition("token", "wallet")
        x = x.groupBy("token", "wallet", "year").agg(F.sum("units").alias("units"))
        upto = Window.partitionBy("token", "wallet").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
        return x.select("token", "wallet", F.unix_timestamp(F.make_date(F.col("year") + 1, F.lit(1), F.lit(1)).cast("timestamp")).alias("bt"), F.sum("units").over(upto).alias("balance"))


#: The same views for DuckDB, each in terms of the registered tables or of views before it.
SQL = {
    "flows": f"""SELECT (user_id % 40)::VARCHAR AS wallet, event_type AS token, ({T0} + floor((epoch(ts) - {T0}) / 120))::BIGINT AS bt,
      CASE WHEN json_extract_string(props, '$.k')::INT < 60 THEN 'buy' ELSE 'sell' END AS direction, round(value * 0.25 * 1e9)::BIGINT AS lamports, 'sig' || event_id AS signature, event_id AS seq
      FROM events WHERE value > 0""",
    "trades": """SELECT 'tx' || l_orderkey || '-' || l_linenumber AS signature, l_suppkey::VARCHAR AS wallet, (l_partkey % 200)::VARCHAR AS token,
      (epoch(l_shipdate)::BIGINT + (l_orderkey * 7919 + l_linenumber::BIGINT * 104729) % 86400)::BIGINT AS bt, CASE WHEN l_returnflag = 'R' THEN 'out' ELSE 'in' END AS flow_direction,
      round(l_extendedprice * 100)::BIGINT * 10000 AS lamports, ['raydium', 'orca', 'pump'][l_partkey % 3 + 1] AS dex, CASE WHEN l_linenumber = 7 THEN 'Err' END AS err,
      l_quantity::BIGINT AS units, l_orderkey AS seq, l_linenumber::BIGINT AS line FROM lineitem""",
    "valid": "SELECT * FROM trades WHERE err IS NULL OR err = ''",
    "mint_liquidity": "SELECT p_partkey::VARCHAR AS token, round(p_retailprice * 100)::BIGINT AS liquidity, (p_size % 2)::INT AS lp_lock_flag, p_brand AS primary_pool FROM part",
    "mint_metadata": "SELECT p_partkey::VARCHAR AS token, CASE WHEN p_size % 3 = 0 THEN 'auth' || p_size END AS mint_authority, CASE WHEN p_size % 5 = 0 THEN 'auth' || p_size END AS freeze_authority, p_size % 7 = 0 AS is_mutable FROM part",
    "edges": """SELECT a.w AS wallet_a, b.w AS wallet_b, count(*) AS weight FROM (SELECT DISTINCT l_orderkey, l_suppkey::VARCHAR AS w FROM lineitem) a
      JOIN (SELECT DISTINCT l_orderkey, l_suppkey::VARCHAR AS w FROM lineitem) b USING (l_orderkey) WHERE a.w < b.w GROUP BY a.w, b.w""",
    "members": "SELECT s_suppkey::VARCHAR AS wallet, s_nationkey::BIGINT AS group_id FROM supplier",
    "names": "SELECT s_suppkey::VARCHAR AS address, s_name AS name FROM supplier",
    "mcap": "SELECT (o_custkey % 200)::VARCHAR AS token, epoch(o_orderdate)::BIGINT AS mcap_time, round(o_totalprice * 100)::BIGINT AS mcap FROM orders",
    "liquidity_events": "SELECT (o_custkey % 200)::VARCHAR AS token, epoch(o_orderdate)::BIGINT AS bt, CASE WHEN o_orderstatus = 'F' THEN 'remove' ELSE 'add' END AS action, round(o_totalprice * 100)::BIGINT AS amount, o_orderkey AS seq FROM orders",
}


def oracle(body: str, *views: str, **ctes: str) -> str:
    """body over the named views and further CTEs."""
    views = ("trades", *views) if "valid" in views and "trades" not in views else views
    parts = [f"{v} AS ({SQL[v]})" for v in SQL if v in views] + [f"{k} AS ({v})" for k, v in ctes.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
