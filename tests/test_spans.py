"""A batch of many windows needs few folders, and its documents go when the last of a folder's windows has closed."""

from __future__ import annotations

import os
import tempfile

import pytest
from helpers import as_set, brute_couples

from docweave.plans.partitioning import Options
from docweave.streaming import ledger
from docweave.streaming.batches import end_windows, read_couples, stream_partitioned_join, stream_window_join

SCHEMA = "w long, doc long, m map<string,string>, source string"
BATCHES = [[w for w in range(-3, 9) for _ in range(3)], [0, 5, 8, 8, 12], list(range(6, 20)), [40]]


def folders(path, name):
    at = f"{path}/{name}"
    return sorted(f for f in os.listdir(at) if "=" in f) if os.path.isdir(at) else []


@pytest.mark.parametrize("delay", [None, 2])
def test_many_windows_share_folders(spark, monkeypatch, delay):
    monkeypatch.setattr(ledger, "SPAN", 4)
    source, out = (tempfile.mkdtemp(prefix="run-", dir="/tmp") for _ in range(2))
    docs = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    rows, kept = [], []
    for ws in BATCHES:
        new = [(w, 1000 * len(kept) + i, {"a": str(i % 2), "b": str(i % 3)}) for i, w in enumerate(ws)]
        rows += [r for r in new if delay is None or not kept or r[0] > max(x[0] for x in rows) - 1 - delay]
        spark.createDataFrame([(*r, "x") for r in new], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        if delay is None:
            stream_window_join(docs, out).awaitTermination()
        else:
            stream_partitioned_join(docs, out, Options(k=2), delay=delay).awaitTermination()
        kept.append((folders(out, "documents"), folders(out, "spans")))
    if delay is not None:
        end_windows(docs, out, Options(k=2))
        assert folders(out, "spans") == folders(out, "documents") == []
        assert kept[0][1] == ["span=1", "span=2"] and kept[-1][1] == []
    else:
        assert kept[0] == ([], ["span=-1", "span=0", "span=1", "span=2"])
        assert kept[1][0] == ["w=0", "w=12", "w=5", "w=8"] and len(kept[-1][1]) == 6
    assert as_set(read_couples(spark, out), "w", "a", "b") == brute_couples(rows)
