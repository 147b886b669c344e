"""The stateful stream: the first text of a payload_id is masked, later ones are restored.

Detection, decisions and masking run before the state as plain expressions on the stream, so they use all of the
engine; the state keeps only each key's record, for its time to live. The stateful part compares fingerprints and
splices; texts that have to be searched for surrogates leave it and are restored by the same expressions as in batch. Requests of one key are handled one after the other in the order of ``seq``.

Two value states hold the record, as a state's time to live is fixed: ``active`` and, after restoring,
``grace``. Expiry is honoured whenever a record is read.
"""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.demask import restored
from ..operators.entities import MAPPING
from ..operators.mask import masked
from ..plans.pipelines import analyze
from ..sources.vault import GRACE_SECONDS, TTL_SECONDS

ANSWER = "payload_id string, seq bigint, direction string, status int, result string"
#: Rows of the stateful part: for texts whose needles are still to be searched, the text stands in result, and its record's mode and mappings beside it.
_OPEN = ANSWER + ", mode string, mappings string"
SEARCHED = object()


def fingerprint(text: str, secret: str | None) -> str:
    return hmac.new(secret.encode(), text.encode(), hashlib.sha256).hexdigest() if secret else hashlib.sha256(text.encode()).hexdigest()


def splice(text: str, occurrences: list[dict], start: str, end: str, new: str) -> str:
    out, at = [], 0
    for o in sorted(occurrences, key=lambda o: o[start]):
        out += [text[at : o[start]], o[new]]
        at = o[end]
    return "".join([*out, text[at:]])


def respond(record: dict | None, row: dict, secret: str | None, allow_demask: bool) -> tuple[dict | None, str, int, str | None]:
    """(record to keep, direction, status, result) of one request. A result that has to be searched for in the text is left open (SEARCHED)."""
    text = row["payload"]
    if record is None:
        record = {
            "mode": row["mode"], "original": fingerprint(text, secret), "masked": fingerprint(row["masked_text"], secret), "demask": allow_demask,
            "mappings": json.loads(row["mappings"]), "occurrences": json.loads(row["occurrences"]), "grace": False, "answered": False,
        }
        return record, "mask", 200, row["masked_text"]
    print_ = fingerprint(text, secret)
    if print_ == record["original"]:
        return record, "retry_mask", 200, splice(text, record["occurrences"], "original_start", "original_end", "masked")
    if not record["answered"]:
        # another first text for the same key in the same batch: nobody has seen the masked text yet
        return record, "mask", 409, None
    if not record["demask"] or not allow_demask:
        return record, "demask", 200, text
    if print_ == record["masked"]:
        return record | {"grace": True}, "demask", 200, splice(text, record["occurrences"], "masked_start", "masked_end", "original")
    return record | {"grace": True}, "demask", 200, SEARCHED


class Keeper(StatefulProcessor):
    def __init__(self, secret: str | None, ttl: int, grace: int, allow_demask: bool):
        self.secret, self.ttl, self.grace_ttl, self.allow = secret, ttl, grace, allow_demask

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.active = handle.getValueState("active", "record string", ttlDurationMs=self.ttl * 1000)
        self.grace = handle.getValueState("grace", "record string", ttlDurationMs=self.grace_ttl * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        state = self.grace if self.grace.exists() else self.active
        record = json.loads(state.get()[0]) if state.exists() else None
        was_in_grace, known = bool(record and record["grace"]), record is not None
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        out = []
        for row in batch.to_dict("records"):
            record, direction, status, result = respond(record, row, self.secret, self.allow)
            search = result is SEARCHED
            out.append((key[0], row["seq"], direction, status, row["payload"] if search else result, record["mode"] if search else None, json.dumps(record["mappings"]) if search else None))
        if not known:
            self.active.update((json.dumps(record | {"answered": True}),))
        if record["grace"] and not was_in_grace:
            self.active.clear()
            self.grace.update((json.dumps(record),))
        yield pd.DataFrame(out, columns=["payload_id", "seq", "direction", "status", "result", "mode", "mappings"])

    def close(self) -> None:
        pass


def process_stream(requests: DataFrame, mode: str = "partial", secret: str | None = None, ttl: int = TTL_SECONDS, grace: int = GRACE_SECONDS, allow_demask: bool = True) -> DataFrame:
    """Answers to a stream of requests (payload_id, seq, payload). It needs the RocksDB state store; see :func:`configure`."""
    done = masked(analyze(requests, "payload"), mode, "payload", session="payload_id")
    ready = done.select("payload_id", "seq", "payload", "mode", "masked_text", F.to_json("mappings").alias("mappings"), F.to_json("occurrences").alias("occurrences"))
    told = ready.groupBy("payload_id").transformWithStateInPandas(Keeper(secret, ttl, grace, allow_demask), _OPEN, "Append", "ProcessingTime")
    searched = restored(F.col("result"), F.col("mode"), F.from_json("mappings", f"array<{MAPPING}>"))
    return told.select("payload_id", "seq", "direction", "status", F.when(F.col("mode").isNull(), F.col("result")).otherwise(searched).alias("result"))


def configure(spark) -> None:
    """Session settings of the stream. Without the last one a stream with processing-time state never ends by itself."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
