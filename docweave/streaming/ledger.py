"""Windows of a stream: their documents by window, when they close, and what came too late."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.session import names, remove, stage

DOCUMENTS = "documents"
SPANS = "spans"
INCOMING = "incoming"
LATE = "late"
LEDGER = "ledger"
_ROWS = "kind string, source string, w long"
SPAN = 256  # windows that share a folder where a batch touches more of them than that


def none_if_missing(read: Callable[[], DataFrame]) -> DataFrame | None:
    """What ``read`` reads, or None before its first write."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    return none_if_missing(lambda: spark.read.parquet(path))


@dataclass(frozen=True)
class Windows:
    """``high``: the newest window of each source; ``open``: windows whose documents are kept;
    ``closed``: the newest window that is done with, as are all before it."""

    high: dict[str, int] = field(default_factory=dict)
    open: frozenset[int] = frozenset()
    closed: int | None = None
    ended: bool = False


class WindowLedger:
    """Documents under ``path/documents/w=.../batch=...`` and the state of windows per batch.

    A batch is first written as it comes, under ``path/incoming``, and read from there until it
    is done; the folders of windows, a file for each of a batch, are read by later batches only.
    A batch of more than ``SPAN`` windows is kept under ``path/spans/span=.../batch=...``, so many
    windows to a folder; it is deleted when the last of them has closed.
    A window closes when every source has gone more than ``delay`` windows beyond it.  Documents
    of closed windows that come later go to ``path/late``.  A batch is done once its ledger row is
    written; a batch that is run again after that changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, delay: int | None):
        self.spark, self.path, self.delay = spark, path, delay

    def load(self, before: int | None = None) -> tuple[int, Windows]:
        """The last batch (before one) and its windows; -1 where there is none."""
        rows = read_or_none(self.spark, f"{self.path}/{LEDGER}")
        if rows is not None and before is not None:
            rows = rows.where(F.col("batch") < before)
        last = None if rows is None else rows.agg(F.max("batch")).first()[0]
        if last is None:
            return -1, Windows()
        held = rows.where(F.col("batch") == last).collect()  # a row per source and open window
        closed = [r["w"] for r in held if r["kind"] == "closed"]
        return last, Windows(
            {r["source"]: r["w"] for r in held if r["kind"] == "high"},
            frozenset(r["w"] for r in held if r["kind"] == "open"),
            closed[0] if closed else None,
            any(r["kind"] == "ended" for r in held),
        )

    def add(self, new: DataFrame, batch: int) -> tuple[Windows, list[int], list[int], list[int]] | None:
        """Keep a batch; its windows afterwards, those it touched, those of them that had documents
        before, and those it closes.

        None if the batch was done before.
        """
        last, now = self.load()
        if now.ended:
            raise ValueError(f"the stream of {self.path} was ended; start another one elsewhere")
        if last >= batch:
            return None
        source = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in new.columns else F.lit("")
        rows = new.select(F.col("w").cast("bigint").alias("w"), "doc", "m", source.alias("source"))
        rows.write.mode("overwrite").parquet(f"{self.path}/{INCOMING}/batch={batch}")
        came = self.incoming(new, batch)
        seen = came.groupBy("source").agg(F.max("w").alias("high"), F.collect_set("w").alias("ws")).collect()
        touched = sorted({w for r in seen for w in r["ws"]})
        if now.closed is not None and touched and touched[0] <= now.closed:
            late = F.coalesce(F.col("w") <= now.closed, F.lit(False))
            came.where(late).select("w", "doc", "m").write.mode("overwrite").parquet(f"{self.path}/{LATE}/batch={batch}")
            came = came.where(~late)
            touched = [w for w in touched if w > now.closed]
        wide = len(touched) > SPAN
        by, folder = ("span", SPANS) if wide else ("w", DOCUMENTS)
        if wide:
            came = came.withColumn("span", F.floor(F.col("w") / SPAN))
        (
            came.withColumn("batch", F.lit(batch)).hint("rebalance", F.col(by))
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy(by, "batch").parquet(f"{self.path}/{folder}")
        )
        high = dict(now.high)
        for r in seen:
            high[r["source"]] = max(high.get(r["source"], r["high"]), r["high"])
        closed = now.closed
        if self.delay is not None and high:
            done = min(high.values()) - 1 - self.delay
            closed = done if closed is None else max(closed, done)
        open_ = now.open | set(touched)
        closing = sorted(w for w in open_ if closed is not None and w <= closed)
        known = [w for w in touched if w in now.open]
        return Windows(high, frozenset(open_ - set(closing)), closed), touched, known, closing

    def incoming(self, like: DataFrame, batch: int) -> DataFrame:
        """(w, doc, m, source) of a batch that is not yet done, late documents included."""
        kind = like.schema["doc"].dataType.simpleString()
        reader = self.spark.read.schema(f"w long, doc {kind}, m map<string,string>, source string")
        return reader.parquet(f"{self.path}/{INCOMING}/batch={batch}")

    def documents(self, windows: list[int], like: DataFrame, before: int | None = None) -> DataFrame:
        """(w, doc, m) of some windows (of the batches before one); only their folders are listed.

        Staged: folders of windows hold small files, which are opened once here and not by every later job.
        """
        kind = like.schema["doc"].dataType.simpleString()
        if not windows:
            return self.spark.createDataFrame([], f"w long, doc {kind}, m map<string,string>")
        reader = self.spark.read.schema(f"doc {kind}, m map<string,string>, w long, batch int")
        found = []
        for folder, by, wanted in ((DOCUMENTS, "w", windows), (SPANS, "span", {w // SPAN for w in windows})):
            there = set(names(self.spark, f"{self.path}/{folder}"))
            paths = [f"{self.path}/{folder}/{at}" for at in (f"{by}={n}" for n in wanted) if at in there]
            if paths:
                rows = reader.option("basePath", f"{self.path}/{folder}").parquet(*paths)
                found.append((rows if before is None else rows.where(F.col("batch") < before)).select("w", "doc", "m"))
        rows = reduce(DataFrame.unionByName, found)
        low, high = min(windows), max(windows)
        if high - low + 1 > len(windows):
            rows = rows.join(stage(self.spark.createDataFrame([(w,) for w in windows], "w long")), "w", "left_semi")
        return stage(rows.where(F.col("w").between(low, high)))

    def commit(self, batch: int, windows: Windows, dropped: list[int]) -> None:
        """Write the state, which ends the batch, and then delete what is no longer needed."""
        rows = [("high", s, w) for s, w in windows.high.items()] + [("open", "", w) for w in sorted(windows.open)]
        rows += [("closed", "", windows.closed)] if windows.closed is not None else []
        rows += [("ended", "", None)] if windows.ended else []
        self.spark.createDataFrame(rows, _ROWS).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{LEDGER}/batch={batch}")
        gone = [f"w={w}" for w in dropped]
        there = set(names(self.spark, f"{self.path}/{DOCUMENTS}")) if gone else set()
        remove(self.spark, *[f"{self.path}/{DOCUMENTS}/{w}" for w in gone if w in there], f"{self.path}/{INCOMING}/batch={batch}")
        spans = [n for n in names(self.spark, f"{self.path}/{SPANS}") if n.startswith("span=")] if gone else []
        over = lambda span: windows.ended or (int(span[5:]) + 1) * SPAN - 1 <= windows.closed
        remove(self.spark, *[f"{self.path}/{SPANS}/{span}" for span in spans if over(span)])
        remove(self.spark, f"{self.path}/{LEDGER}/batch={batch - 2}")  # a batch needs the one before it only


def read_late(spark: SparkSession, path: str) -> DataFrame:
    """(w, doc, m) of documents that came after their window had closed."""
    late = read_or_none(spark, f"{path}/{LATE}")
    if late is None:
        return spark.createDataFrame([], "w long, doc string, m map<string,string>")
    return late.select("w", "doc", "m")
