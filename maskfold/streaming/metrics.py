"""Metrics of a running stream: aggregates observed on the way, gathered by a listener from the progress of each micro-batch."""

from __future__ import annotations

from collections import Counter
from threading import Lock

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..functions.scalars import token_count

NAME = "requests"


def observed(answers: DataFrame, name: str = NAME) -> DataFrame:
    """``answers`` (direction, status, result) with counts of each direction, of errors and of tokens observed as they pass; no row is changed and none is shuffled."""
    count = lambda fits: F.count(F.when(fits, 1))
    status, direction = F.col("status"), F.col("direction")
    return answers.observe(
        name, F.count(F.lit(1)).alias("requests"), count((status == 200) & (direction == "mask")).alias("mask"), count((status == 200) & (direction == "retry_mask")).alias("retry_mask"),
        count((status == 200) & (direction == "demask")).alias("demask"), count(status == 409).alias("conflict"), count((status >= 400) & (status != 409)).alias("other_errors"),
        F.coalesce(F.sum(token_count(F.coalesce("result", F.lit("")))), F.lit(0)).alias("tokens"),
    )


class Metrics(StreamingQueryListener):
    """Counters since the start, and gauges of the last micro-batch. To be added to ``spark.streams``."""

    def __init__(self, name: str = NAME):
        self.name, self._lock = name, Lock()
        self.counters: Counter[str] = Counter()
        self.gauges: dict[str, float] = {}
        self.failed: list[str] = []

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        row = event.progress.observedMetrics.get(self.name)
        if row is None:
            return
        with self._lock:
            self.counters.update(row.asDict())
            self.counters["batches"] += 1
            self.gauges = {"input_rows": event.progress.numInputRows, "batch_ms": event.progress.durationMs.get("triggerExecution", 0), "keys_held": sum(s.numRowsTotal for s in event.progress.stateOperators)}

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if event.exception:
            with self._lock:
                self.failed.append(str(event.id))
