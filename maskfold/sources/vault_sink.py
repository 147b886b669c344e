"""The vault as the sink of a stream: micro-batches of changes merged into a table, each exactly once.

A change saves a record, if the key has no live one, or takes a live record over to the grace state, once. The changes of one
micro-batch go to ``updates/batch=<id>`` as the new state of each key they touch. Such a table counts once it is complete, and
a micro-batch that comes again after a failure finds it and changes nothing, or writes the same rows again. A key's state is that of its last
batch. Every ``compact_every`` batches all states become one table under ``base``, without the records that have expired by then,
and the generation before is removed.

A micro-batch reads the vault's states (a scan that the batch's keys are joined with), shuffles its own changes and the states they touch, and writes
the latter; the folding handles one key after the other, in the order of ``seq``, with the state of one key in memory.

Defined results: changes with a null key, seq, op or time are left out; repeated changes (one key and seq) count once; a change of another kind than
``save`` and ``demask`` is left out; a record that expires at the moment of a change has expired.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.folds import folded
from .shared import Files
from .vault import ACTIVE, GRACE, GRACE_SECONDS, TTL_SECONDS

#: What a saved record holds beside its state and times.
HELD = ("version", "mode", "original_fingerprint", "transformed_fingerprint", "no_pii", "demask_enabled", "mappings", "occurrences")
_STATE = "payload_id string, seq long, state string, created_at timestamp, demasked_at timestamp, expires_at timestamp"
_FOLDED = ("seq", "state", "created_at", "demasked_at", "expires_at")


def _steps(ttl: int, grace: int):
    """The fold over a key's changes: the state is (seq, state, created, demasked, expires) of the record it has."""

    def step(state: list, event: tuple) -> tuple:
        op, at, *held = event
        if op == "held":
            state[:] = held
        else:
            live = state[1] is not None and state[4] > at
            if op == "save" and not live:
                state[:] = [held[0], ACTIVE, at, None, at + dt.timedelta(seconds=ttl)]
            elif op == "demask" and live and state[1] == ACTIVE:
                state[1:] = [GRACE, state[2], at, at + dt.timedelta(seconds=grace)]
        return tuple(state)

    return step


class VaultSink:
    """Merges micro-batches of changes (payload_id, seq, op, at, and of saved records the columns of ``HELD`` as far as there are any) into the vault
    at ``path``, a folder that all executors share. To be given to ``foreachBatch``."""

    def __init__(self, spark: SparkSession, path: str, ttl: int = TTL_SECONDS, grace: int = GRACE_SECONDS, compact_every: int = 16):
        self.spark, self.path, self.ttl, self.grace, self.every = spark, path.rstrip("/"), ttl, grace, compact_every
        self.files = Files(spark, self.path)

    def _generations(self) -> list[int]:
        return sorted(int(n.partition("=")[2]) for n in self.files.names("base") if self.files.complete(f"base/{n}"))

    def _batches(self, after: int, upto: int) -> list[int]:
        numbers = [int(n.partition("=")[2]) for n in self.files.names("updates")]
        return sorted(n for n in numbers if after < n <= upto and self.files.complete(f"updates/batch={n}"))

    def vault(self, upto: int | None = None) -> DataFrame | None:
        """The last state of each key after the batches up to ``upto`` (all if None); expired records may be among them. None before the first batch."""
        upto = (1 << 62) if upto is None else upto
        base = max((g for g in self._generations() if g <= upto), default=-1)
        paths = [(base, f"base/upto={base}")] if base >= 0 else []
        paths += [(n, f"updates/batch={n}") for n in self._batches(base, upto)]
        if not paths:
            return None
        frames = [self.spark.read.parquet(f"{self.path}/{p}").withColumn("_batch", F.lit(n)) for n, p in paths]
        rows = frames[0]
        for f in frames[1:]:
            rows = rows.unionByName(f)
        names = [c for c in rows.columns if c not in ("payload_id", "_batch")]
        last = rows.groupBy("payload_id").agg(F.max_by(F.struct(*names), "_batch").alias("_last"))
        return last.select("payload_id", *[F.col(f"_last.{c}").alias(c) for c in names])

    def merged(self, changes: DataFrame, held: DataFrame | None) -> DataFrame:
        """The new states of the keys that ``changes`` touch."""
        changes = changes.where(F.col("payload_id").isNotNull() & F.col("seq").isNotNull() & F.col("at").isNotNull() & F.col("op").isin("save", "demask")).dropDuplicates(["payload_id", "seq"])
        record = [c for c in HELD if c in changes.columns]
        null = lambda kind: F.lit(None).cast(kind)
        log = changes.select("payload_id", F.lit(1).alias("turn"), "op", "at", "seq", null("string").alias("state"), *[null("timestamp").alias(c) for c in _FOLDED[2:]])
        saved = changes.where("op = 'save'").select("payload_id", "seq", *record)
        if held is not None:
            touched = held.join(changes.select("payload_id").distinct(), "payload_id", "left_semi")
            log = log.unionByName(touched.select("payload_id", F.lit(0).alias("turn"), F.lit("held").alias("op"), null("timestamp").alias("at"), *_FOLDED))
            saved = saved.unionByName(touched.where("seq is not null").select("payload_id", "seq", *record))
        schema = T.StructType([f for f in T._parse_datatype_string(_STATE).fields if f.name != "payload_id"])
        states = folded(log, "payload_id", ["turn", "seq"], ["op", "at", *_FOLDED], lambda: [None] * 5, _steps(self.ttl, self.grace), schema, last_only=True)
        return states.where("seq is not null").join(saved.dropDuplicates(["payload_id", "seq"]), ["payload_id", "seq"], "left")

    def __call__(self, changes: DataFrame, batch_id: int) -> None:
        name = f"updates/batch={batch_id}"
        if any(g >= batch_id for g in self._generations()):
            return
        if not self.files.complete(name):
            # a stream's batch runs anew with each action, and it is used more than once
            changes = changes.persist()
            try:
                self.merged(changes, self.vault(batch_id - 1)).write.mode("overwrite").parquet(f"{self.path}/{name}")
            finally:
                changes.unpersist()
        if (batch_id + 1) % self.every == 0:
            self.compact(batch_id)

    def compact(self, batch_id: int) -> None:
        """One table of all states after the batch; what had expired at the last moment that the batches know is purged."""
        before = self._generations()
        states = self.vault(batch_id)
        if states is None:
            return
        moment = states.agg(F.max(F.coalesce("demasked_at", "created_at")).alias("at")).first().at
        states.where(F.col("expires_at") > F.lit(moment)).write.mode("overwrite").parquet(f"{self.path}/base/upto={batch_id}")
        # readers of the generation just replaced may still be at work, those of the one before are not
        for g in before[:-1]:
            self.files.remove(f"base/upto={g}")
        for n in self._batches(-1, before[-1] if before else -1):
            self.files.remove(f"updates/batch={n}")


def vault_stream(changes: DataFrame, sink: VaultSink, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Starts the stream of changes into the sink: what is there now if ``every`` is None, or a micro-batch at each such interval."""
    writer = changes.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()
