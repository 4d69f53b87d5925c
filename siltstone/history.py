"""What was asked: an event log of one small file an event, which any number of drivers can write to."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.fs import Files

SHOWN = 100
_SCHEMA = "id string, event string, at double, workspace string, user string, dataset string, source string, input string, plan string, optimized_plan string, status string, duration_ms long, rows long, cache_hit boolean, error string"


class History:
    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], float] = time.time):
        self.spark, self.root, self.files, self.clock = spark, f"{root.rstrip('/')}/history", Files(spark), clock
        self._began: dict[str, float] = {}

    def _write(self, entry: dict) -> None:
        at = self.clock()
        self.files.write_new(f"{self.root}/{int(at * 1e6):020d}-{uuid.uuid4().hex}.json", json.dumps(entry | {"at": at}).encode())

    def start(self, source: str, text: str, dataset: str, workspace: str, user: str = "") -> str:
        k = uuid.uuid4().hex
        self._began[k] = self.clock()
        self._write({"id": k, "event": "start", "status": "running", "source": source, "input": text, "dataset": dataset, "workspace": workspace, "user": user})
        return k

    def plan(self, k: str, plan: str | None, optimized: str | None) -> None:
        self._write({"id": k, "event": "plan", "plan": plan, "optimized_plan": optimized})

    def finish(self, k: str, rows: int | None = None, error: str | None = None, cache_hit: bool = False) -> None:
        took = int(1000 * (self.clock() - self._began.pop(k, self.clock())))
        self._write({"id": k, "event": "finish", "status": "failed" if error else "succeeded", "duration_ms": took, "rows": rows, "error": error, "cache_hit": cache_hit})

    def frame(self, workspace: str | None = None) -> DataFrame:
        """A row a query, all events of it folded together."""
        if not self.files.names(self.root):
            events = self.spark.createDataFrame([], _SCHEMA)
        else:
            events = self.spark.read.schema(_SCHEMA).json(self.root)
        order = F.when(F.col("event") == "finish", 2).when(F.col("event") == "plan", 1).otherwise(0)
        fold = {c: F.max(F.col(c)) for c in ("workspace", "user", "dataset", "source", "input", "plan", "optimized_plan", "duration_ms", "rows", "cache_hit", "error")}
        out = events.groupBy("id").agg(F.min("at").alias("submitted_at"), F.max_by("status", F.when(F.col("status").isNotNull(), order)).alias("status"), *(v.alias(c) for c, v in fold.items()))
        return out if workspace is None else out.where(F.col("workspace") == workspace)

    def newest(self, workspace: str | None = None, n: int = SHOWN) -> list[dict]:
        return [r.asDict() for r in self.frame(workspace).orderBy(F.desc("submitted_at")).limit(n).collect()]
