"""File scans and sinks with fixed schemas: event log CSV, transition TSV, session JSON lines, seed lists, name maps, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewake.functions.scalar import clean_text

# Columns of the event log and of the transition log.
EVENT_COLUMNS = ("event_id", "event_type", "signature", "slot", "block_time", "program_id", "token_mint", "pool_id", "actors_json", "amounts_json", "source", "version")
TRANSITION_COLUMNS = ("transition_id", "entity_type", "entity_address", "token_mint", "from_state", "to_state", "trigger", "block_time", "signature", "version")


def write_events(events: DataFrame, path: str) -> None:
    """SRC-6: events (actors array, amounts map, other columns text) as CSV with a header; amounts with sorted keys."""
    amounts = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("amounts"))))
    x = events.withColumn("actors_json", F.to_json("actors")).withColumn("amounts_json", amounts)
    x.select(*[F.col(c).cast("string") for c in EVENT_COLUMNS]).write.option("header", True).option("escape", '"').csv(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """SRC-6: the event log with actors and amounts parsed."""
    schema = ", ".join(f"{c} string" for c in EVENT_COLUMNS)
    x = spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
    x = x.withColumn("actors", F.from_json("actors_json", "array<string>")).withColumn("amounts", F.from_json("amounts_json", "map<string,string>"))
    return x.withColumn("slot", F.col("slot").try_cast("long")).withColumn("block_time", F.col("block_time").try_cast("long")).drop("actors_json", "amounts_json")


def write_tsv(df: DataFrame, path: str) -> None:
    """SRC-7, SRC-22: a table as TSV with a header; tabs and line ends in values become blanks."""
    df.select(*[clean_text(F.col(c)).alias(c) for c in df.columns]).write.option("header", True).option("sep", "\t").option("emptyValue", "").csv(path)


def read_tsv(spark: SparkSession, path: str, columns: tuple[str, ...] = TRANSITION_COLUMNS) -> DataFrame:
    """SRC-7: a TSV of text columns."""
    return spark.read.schema(", ".join(f"{c} string" for c in columns)).option("header", True).option("sep", "\t").csv(path)


def write_ordered(df: DataFrame, order: list[Column], path: str, partitions: int | None = None) -> None:
    """TOP-8, SRC-22: a whole report in order: sorted range partitions, with _part and _at, the number of a row in its partition. No task sees more than its range."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    x.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at")).write.parquet(path)


def read_ordered(spark: SparkSession, path: str, number: str = "row_no") -> DataFrame:
    """The rows of write_ordered() with their number in the whole report, from 1: rows of the partitions before and the place in their own."""
    x = spark.read.parquet(path)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each partition, whose number the writer sets
    parts = x.groupBy("_part").agg(F.count("*").alias("_c")).select(F.col("_part").alias("_p"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    x = x.join(F.broadcast(parts), F.col("_part") == F.col("_p"))
    return x.withColumn(number, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_p", "_before")


SESSION_SCHEMA = "event_type string, timestamp long, wallet string, token_ca string, signals array<string>, from_state string, to_state string, trigger string, details string"


def read_session(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC-8: (rows, malformed lines) of a session log of JSON lines; blank lines are neither."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    sound = F.try_parse_json("value").isNotNull()
    rows = lines.where(sound).select(F.from_json("value", SESSION_SCHEMA).alias("r")).select("r.*").where("event_type IS NOT NULL")
    return rows, lines.where(~sound).select(F.col("value").alias("line"))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """SRC-18: (address, name) of a JSON object of names; values that are not text are left out."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"), F.col("value").alias("t"))
    return raw.select("t", F.explode("m").alias("address", "name")).where(F.col("name").isNotNull() & (F.col("name") != "")).select("address", "name")


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """SRC-17: lines of a seed list with their places (one file)."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\n")).alias("line_no", "value"))
