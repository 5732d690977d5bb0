"""Documents made from the given tables, used by the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.session import stage
from docweave.sources.tables import documents_from_table

WINDOW = 500
K = 8
PARTS = 4  # rows of every posting or partner list


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mixed_attrs() -> dict[str, Column]:
    """Four optional attributes of an event; none is universal."""
    i = F.col("event_id")
    return {
        "event_type": F.when(i % 7 != 0, F.col("event_type")),
        "user": F.when(F.col("event_type") != "error", F.col("user_id")),
        "k": F.when(i % 3 != 0, F.get_json_object("props", "$.k")),
        "grp": F.when(i % 5 != 0, F.col("user_id") % 4),
    }


def mixed_events(spark: SparkSession, sf_dir: str, window: int = WINDOW) -> DataFrame:
    """Events with four optional attributes, ``window`` documents each."""
    i = F.col("event_id")
    return documents_from_table(
        table(spark, sf_dir, "events"), "event_id", mixed_attrs(), w=F.floor(i / window)
    )


def wide_attrs() -> dict[str, Column]:
    """Eight optional attributes of a line item."""
    i = F.col("doc")

    def text(*names: str) -> Column:
        return F.concat_ws("-", *(F.col(n).cast("string") for n in names))

    return {
        "part": F.when(i % 2 == 0, text("l_partkey")),
        "order": F.when(i % 3 == 0, text("l_orderkey")),
        "stock": F.when(i % 5 == 0, text("l_suppkey", "l_partkey")),
        "line": F.when(i % 7 == 0, text("l_orderkey", "l_returnflag")),
        "flag": F.when(i % 4 == 1, text("l_partkey", "l_returnflag")),
        "state": F.when(i % 6 == 1, text("l_partkey", "l_linestatus")),
        "supplied": F.when(i % 11 == 2, text("l_orderkey", "l_suppkey")),
        "number": F.when(i % 13 == 3, text("l_partkey", "l_linenumber")),
    }


def lines_with(spark: SparkSession, sf_dir: str, attrs: dict) -> DataFrame:
    """All order lines as documents of one window; lines that share order and number are one."""
    least = [F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")]
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*least)
    lines = lines.withColumn("doc", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    # Staged, because joins read their documents several times and making the maps is most of their time.
    return stage(documents_from_table(lines, "doc", attrs))


def wide_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_with(spark, sf_dir, wide_attrs())


def universal_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``event_type`` in every document."""
    attrs = mixed_attrs() | {"event_type": F.col("event_type")}
    del attrs["grp"]
    return documents_from_table(
        table(spark, sf_dir, "events"), "event_id", attrs, w=F.floor(F.col("event_id") / WINDOW)
    )


def keyed(spark: SparkSession, sf_dir: str, name: str, key: str, attrs: list[str]) -> DataFrame:
    """A table's rows with the named columns as attributes, windows of the key range."""
    return documents_from_table(
        table(spark, sf_dir, name), key, {a: a for a in attrs}, w=F.floor(F.col(key) / WINDOW)
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and suppliers in one window: documents of two shapes."""
    nations = documents_from_table(
        table(spark, sf_dir, "nation"),
        F.concat(F.lit("n"), F.col("n_nationkey")),
        {"nationkey": "n_nationkey", "name": "n_name", "regionkey": "n_regionkey"},
    )
    suppliers = documents_from_table(
        table(spark, sf_dir, "supplier"),
        F.concat(F.lit("s"), F.col("s_suppkey")),
        {"nationkey": "s_nationkey", "supplier": "s_name"},
    )
    return nations.unionByName(suppliers)
