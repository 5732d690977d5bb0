"""Windows joined micro-batch by micro-batch with the batch strategies.

Every batch writes under its own id and overwrites it when retried, so a restart from
the checkpoint neither loses nor repeats results.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators.joins import couples, natural_join_partitioned
from docweave.plans.core_attributes import choose_core
from docweave.plans.partitioning import SUMMARY, Options, TableState, serve_windows
from docweave.streaming.ledger import WindowLedger, read_or_none

COUPLES = "couples"
PLANS = "plans"
ROUTES = "routes"
TABLES = "tables"
_META = "version long, rebuild boolean, attrs array<string>, n_docs long, max_load long, avg_comm double"


def _run(documents: DataFrame, path: str, serve, available_now: bool):
    writer = documents.writeStream.foreachBatch(serve).option("checkpointLocation", f"{path}/_progress")
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def stream_window_join(documents: DataFrame, path: str, available_now: bool = True, delay: int | None = None):
    """Join streaming documents ``(w, doc, m[, source])`` per window, whatever order they arrive in.

    A batch joins its documents among themselves and with earlier documents of the same
    windows, so a window may be spread over any number of batches.  Couples are under
    ``path/couples``.  With ``delay`` a window is forgotten when every source has gone more
    than that many windows beyond it, and what comes later still is under ``path/late``.
    """
    # Batches are written first and then served from the table in the caller's session, so
    # adaptive execution applies to them as to any batch job.
    spark = documents.sparkSession
    ledger = WindowLedger(spark, path, delay)

    def serve(new: DataFrame, batch: int) -> None:
        added = ledger.add(new, batch)
        if added is None:
            return
        windows, touched, known, closing = added
        if touched:
            # Only windows this batch touches are read back, and of them those that were there before.
            fresh = ledger.incoming(new, batch).where(F.col("w") >= touched[0]).select("w", "doc", "m")
            earlier = ledger.documents(known, new, batch)
            core = choose_core(fresh.unionByName(earlier))
            found = couples(fresh, None, core)
            if known:
                found = found.unionByName(couples(fresh, earlier, core))
            found.select(
                "w", F.least("doc_a", "doc_b").alias("a"), F.greatest("doc_a", "doc_b").alias("b")
            ).write.mode("overwrite").parquet(f"{path}/{COUPLES}/batch={batch}")
        ledger.commit(batch, windows, closing)

    return _run(documents, path, serve, available_now)


class PartitionTableState:
    """Partition table, baseline and version carried across batches, one folder per batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def load(self, batch: int) -> TableState:
        """State after the last batch before ``batch``."""
        meta = read_or_none(self.spark, f"{self.path}/{TABLES}/meta")
        last = meta and meta.where(F.col("batch") < batch).orderBy(F.desc("batch")).first()
        if not last:
            return TableState()
        return TableState(
            version=last["version"],
            rebuild=last["rebuild"],
            table=self.spark.read.parquet(f"{self.path}/{TABLES}/pairs/batch={last['batch']}"),
            attrs=tuple(last["attrs"]),
            baseline=None if last["n_docs"] is None else (last["n_docs"], last["max_load"], last["avg_comm"]),
        )

    def save(self, batch: int, state: TableState) -> None:
        at = f"batch={batch}"
        state.table.write.mode("overwrite").parquet(f"{self.path}/{TABLES}/pairs/{at}")
        row = (state.version, state.rebuild, list(state.attrs), *(state.baseline or (None, None, None)))
        self.spark.createDataFrame([row], _META).write.mode("overwrite").parquet(f"{self.path}/{TABLES}/meta/{at}")


def _serve_closed(ledger: WindowLedger, like: DataFrame, batch: int, closing: list[int], options: Options) -> None:
    """Couples, plan rows and table state of the windows that a batch closes, in common jobs."""
    spark, path = ledger.spark, ledger.path
    keeper = PartitionTableState(spark, path)
    closed = ledger.documents(closing, like)
    state, routes, rows = serve_windows(keeper.load(batch), closed, options)
    routes.write.mode("overwrite").parquet(f"{path}/{ROUTES}/batch={batch}")
    routes = spark.read.schema(routes.schema).parquet(f"{path}/{ROUTES}/batch={batch}")
    natural_join_partitioned(closed, routes).write.mode("overwrite").parquet(f"{path}/{COUPLES}/batch={batch}")
    spark.createDataFrame(rows, SUMMARY).write.mode("overwrite").parquet(f"{path}/{PLANS}/batch={batch}")
    keeper.save(batch, state)


def stream_partitioned_join(
    documents: DataFrame, path: str, options: Options = Options(), available_now: bool = True, delay: int = 0
):
    """Partitioned join of streaming documents ``(w, doc, m[, source])`` with adaptive partition tables.

    A window may come in any number of batches.  It is served once, when it closes: when every
    source has gone more than ``delay`` windows beyond it; its documents are deleted then.  For
    each window in order the table is chosen before routing, quality is checked once after it,
    and updates or a rebuild take effect with the next window.  So documents that come before
    there is a table are held until theirs is made, and each is routed once.  Couples are under
    ``path/couples``, the partitions of each document under ``path/routes``, one summary row per
    window under ``path/plans``, documents of windows that had closed before under ``path/late``.
    ``end_windows`` serves what is open in the end.
    """
    ledger = WindowLedger(documents.sparkSession, path, delay)

    def serve(new: DataFrame, batch: int) -> None:
        added = ledger.add(new, batch)
        if added is None:
            return
        windows, _, _, closing = added
        if closing:
            _serve_closed(ledger, new, batch, closing, options)
        ledger.commit(batch, windows, closing)

    return _run(documents, path, serve, available_now)


def end_windows(documents: DataFrame, path: str, options: Options = Options()) -> None:
    """Close and serve the windows of ``stream_partitioned_join`` that no later document has closed.

    The stream of ``path`` is over then.  Done once, whatever how often it is called.
    """
    ledger = WindowLedger(documents.sparkSession, path, None)
    last, windows = ledger.load()
    if windows.ended or last < 0:
        return
    closing = sorted(windows.open)
    if closing:
        _serve_closed(ledger, documents, last + 1, closing, options)
    ledger.commit(last + 1, replace(windows, open=frozenset(), closed=max(windows.high.values()), ended=True), closing)


def read_couples(spark: SparkSession, path: str) -> DataFrame:
    """Couples ``(w, a, b)`` written so far by either runner."""
    return spark.read.parquet(f"{path}/{COUPLES}").select("w", "a", "b")


def read_plans(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{PLANS}").drop("batch")


def read_routes(spark: SparkSession, path: str) -> DataFrame:
    """``(w, doc, pids)``: where each document that has a pair was sent."""
    return spark.read.parquet(f"{path}/{ROUTES}").select("w", "doc", "pids")
