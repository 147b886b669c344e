"""The vault as a streaming sink: killed at any point and started again, it holds what the log says."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from maskfold.sources.vault_sink import VaultSink, vault_stream

T0 = dt.datetime(2024, 1, 1)
TTL, GRACE = 100, 20
SCHEMA = "payload_id string, seq long, op string, at timestamp, mode string, mappings array<string>"
# key, second, change
LOG = [
    ("a", 0, "save"), ("a", 10, "demask"), ("a", 15, "demask"), ("a", 29, "save"), ("a", 30, "save"), ("b", 5, "save"), ("b", 50, "save"), ("b", 105, "save"), ("c", 1, "demask"), ("c", 2, "save"),
    ("c", 101, "demask"), ("c", 120, "demask"), ("c", 121, "save"), ("d", 3, "save"), ("e", 4, "save"), ("e", 104, "demask"), ("f", 130, "save"), ("f", 131, "demask"),
]


def folded(log):
    held = {}
    for seq, (key, second, op) in log:
        state = held.get(key)
        live = state and state["expires"] > second
        if op == "save" and not live:
            held[key] = {"seq": seq, "state": "ACTIVE", "expires": second + TTL, "mode": f"m{seq}"}
        elif op == "demask" and live and state["state"] == "ACTIVE":
            held[key] = state | {"state": "DEMASKED_GRACE", "expires": second + GRACE}
    return {k: (v["seq"], v["state"], v["expires"], v["mode"]) for k, v in held.items()}


def held(sink, now=None):
    rows = sink.vault().collect()
    out = {r.payload_id: (r.seq, r.state, int((r.expires_at - T0).total_seconds()), r.mode) for r in rows}
    return {k: v for k, v in out.items() if now is None or v[2] > now}


class Failing(VaultSink):
    """Dies once, in batch ``at``, before or after its work is done."""

    def __init__(self, *args, at, after, **more):
        super().__init__(*args, **more)
        self.at, self.after = at, after

    def __call__(self, changes, batch_id):
        if batch_id == self.at and not self.after:
            raise RuntimeError("killed")
        super().__call__(changes, batch_id)
        if batch_id == self.at:
            raise RuntimeError("killed")


@pytest.fixture
def log(spark, tmp_path):
    """The log in order of time, with repeats, as files of three changes."""
    rows = list(enumerate(sorted(LOG, key=lambda x: x[1])))
    for k in range(0, len(rows), 3):
        part = [(key, seq, op, T0 + dt.timedelta(seconds=s), f"m{seq}", ["x"]) for seq, (key, s, op) in rows[k : k + 3]]
        part += part[:1] + [(None, 1000 + k, "save", T0, "n", []), ("z", 2000 + k, "other", T0, "n", [])]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    return rows, spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))


@pytest.mark.parametrize("after", [False, True])
def test_killed_and_started_again(spark, tmp_path, log, after):
    rows, stream = log
    path, checkpoint = f"file://{tmp_path}/vault", f"file://{tmp_path}/check"
    dying = vault_stream(stream, Failing(spark, path, TTL, GRACE, compact_every=100, at=2, after=after), checkpoint)
    with pytest.raises(Exception, match="killed"):
        dying.awaitTermination(120)
    sink = VaultSink(spark, path, TTL, GRACE, compact_every=100)
    query = vault_stream(stream, sink, checkpoint)
    assert query.awaitTermination(120)
    assert held(sink) == folded(rows)
    # a micro-batch that comes once more changes nothing
    again = spark.createDataFrame([("a", 999, "save", T0 + dt.timedelta(days=1), "late", [])], SCHEMA)
    sink(again, 2)
    assert held(sink) == folded(rows)


def test_compaction_purges_what_has_expired(spark, tmp_path, log):
    rows, stream = log
    sink = VaultSink(spark, f"file://{tmp_path}/vault", TTL, GRACE, compact_every=2)
    assert vault_stream(stream, sink, f"file://{tmp_path}/check").awaitTermination(120)
    last = max(second for _, (_, second, _) in rows)
    assert held(sink, last) == {k: v for k, v in folded(rows).items() if v[2] > last}
    assert len(sink.files.names("base")) <= 2 and len(sink.files.names("updates")) <= 4
    assert "e" not in held(sink)  # gone from the table, not only from what is live


def test_ttl_runs_out_in_both_states(spark, tmp_path):
    sink = VaultSink(spark, f"file://{tmp_path}/vault", TTL, GRACE)
    put = lambda n, op, second: sink(spark.createDataFrame([("k", n, op, T0 + dt.timedelta(seconds=second), f"m{n}", [])], SCHEMA), n)
    put(0, "save", 0)
    put(1, "save", 99)  # still live
    assert held(sink)["k"] == (0, "ACTIVE", 100, "m0")
    put(2, "save", 100)  # expired at this moment
    assert held(sink)["k"] == (2, "ACTIVE", 200, "m2")
    put(3, "demask", 150)
    put(4, "save", 169)
    assert held(sink)["k"] == (2, "DEMASKED_GRACE", 170, "m2")
    put(5, "save", 170)
    assert held(sink)["k"] == (5, "ACTIVE", 270, "m5")


def test_empty_batch_and_vault(spark, tmp_path):
    sink = VaultSink(spark, f"file://{tmp_path}/vault", TTL, GRACE)
    assert sink.vault() is None
    sink(spark.createDataFrame([], SCHEMA), 0)
    assert sink.vault().count() == 0 and sink.vault().where(F.lit(False)).count() == 0
