"""State that runs out across restarts, metrics of a live stream, records as JSON, and what users can plug in; the compact profile's masks."""

import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from maskfold.operators import compact, compact_masks, detectors, mask
from maskfold.plans.pipelines import analyze, inspect_requests
from maskfold.sources import serialization, tables, vault
from maskfold.streaming.metrics import Metrics, observed
from maskfold.streaming.process import configure, process_stream

HIDDEN = "почта <EMAIL_1>"


def test_time_to_live_runs_out_across_restarts(spark, tmp_path):
    """Every call is a stream of its own, started from the checkpoint; both times run out by the clock while none runs."""
    configure(spark)
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    ttl, grace = 60, 30
    metrics = Metrics()
    spark.streams.addListener(metrics)

    def send(n, rows):
        (folder / f"{n}.json").write_text("\n".join(json.dumps({"payload_id": i, "seq": n, "payload": p}, ensure_ascii=False) for i, p in rows), encoding="utf-8")
        stream = spark.readStream.schema("payload_id string, seq bigint, payload string").json(str(folder))
        q = observed(process_stream(stream, "token", ttl=ttl, grace=grace)).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        try:
            assert q.awaitTermination(120)
        finally:
            q.stop()
        got = {r.payload_id: (r.direction, r.status) for r in spark.read.parquet(str(out)).where(f"seq = {n}").collect()}
        return got, time.time()

    try:
        got, first = send(1, [("a", "почта x@ex.com"), ("b", "почта x@ex.com")])
        assert got == {"a": ("mask", 200), "b": ("mask", 200)}
        got, turned = send(2, [("b", HIDDEN)])
        assert got == {"b": ("demask", 200)}
        if time.time() - turned < grace - 15:  # still held, if this machine is quick enough
            assert send(3, [("b", "почта x@ex.com")])[0] == {"b": ("retry_mask", 200)}
        time.sleep(max(0, turned + grace + 1 - time.time()))
        assert send(4, [("b", "другая почта y@ex.com")])[0] == {"b": ("mask", 200)}  # grace is over, though its first time to live may not be
        time.sleep(max(0, first + ttl + 1 - time.time()))
        assert send(5, [("a", "другая почта y@ex.com")])[0] == {"a": ("mask", 200)}
        for _ in range(50):
            if metrics.counters["batches"] >= 4:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(metrics)
    assert metrics.counters["mask"] == 4 and metrics.counters["demask"] == 1 and metrics.counters["requests"] == 5 + metrics.counters["retry_mask"]
    assert metrics.counters["tokens"] > 0 and metrics.gauges["input_rows"] == 1 and not metrics.failed


def test_records_as_json(spark):
    now = F.lit(dt.datetime(2024, 1, 1)).cast("timestamp")
    done = mask.masked(analyze(spark.createDataFrame([("a", "почта x@ex.com")], "payload_id string, payload string"), "payload", only=("email",)), "token", "payload", names=False)
    table = vault.records(done, "payload", now)
    body = serialization.encoded(table)
    text = body.first().body
    assert json.loads(text)["version"] == 2 and "x@ex.com" in text and "почта" not in text
    good, bad = serialization.decoded(body)
    assert good.columns == table.columns and good.collect() == table.collect() and bad.count() == 0
    old = json.loads(text)
    del old["version"], old["demask_enabled"]
    rows = [("old", json.dumps(old)), ("new", json.dumps(old | {"version": 3})), ("odd", "not json"), ("none", None), ("other", "{}")]
    good, bad = serialization.decoded(spark.createDataFrame(rows, "payload_id string, body string"))
    assert [(r.payload_id, r.version, r.demask_enabled) for r in good.collect()] == [("old", 2, True)]
    assert {r.payload_id: r.error for r in bad.collect()} == {"new": "unsupported_version", "odd": "not_a_record", "none": "not_a_record", "other": "not_a_record"}


def test_a_failing_detector_leaves_the_others_alone(spark):
    def tickets(text):
        if "bad" in text:
            raise RuntimeError("no")
        return [(0, 3)]

    registry = detectors.default_registry()
    registry.register("ticket", detectors.python_detector(tickets, "TICKET", "ticket"))
    frame = spark.createDataFrame([(1, "T-1 x@ex.com"), (2, "bad x@ex.com"), (3, None)], "id int, text string")
    found = {r.id: [c.type for c in r.candidates] for r in detectors.detect(frame, only=("email", "ticket"), registry=registry).collect()}
    assert found == {1: ["EMAIL", "TICKET"], 2: ["EMAIL"], 3: []}


def test_own_strategy(spark):
    mask.register_strategy("blank", lambda e: F.repeat(F.lit("_"), F.length(e["value"])))
    try:
        row = mask.masked(analyze(spark.createDataFrame([("пишите x@ex.com",)], "text string"), only=("email",)), "blank", names=False)
        row = row.select("masked_text", mask.put_back(F.col("masked_text"), F.col("occurrences"), True).alias("back")).first()
        assert row.masked_text == "пишите ________" and row.back == "пишите x@ex.com"
        with pytest.raises(ValueError):
            mask.register_strategy("token", lambda e: e["value"])
    finally:
        del mask.STRATEGIES["blank"]


def test_inspection_refuses_what_it_does_not_know(spark):
    rows = [(1, "token", None), (2, "odd", None), (3, None, "nobody"), (4, None, "off")]
    frame = spark.createDataFrame([(*r, "x@ex.com") for r in rows], "id int, mode string, consumer_id string, text string")
    policies = tables.policies(spark, (*tables.POLICIES, ("off", False, True, "partial", ("PHONE",))))
    got = {r.id: r for r in inspect_requests(frame, policies).collect()}
    assert (got[1].status, got[1].masked_text, got[1].round_trip_ok) == (200, "<EMAIL_1>", True)
    assert [(got[i].status, got[i].error, got[i].masked_text) for i in (2, 3)] == [(422, "invalid_mode", None), (404, "unknown_consumer", None)]
    assert (got[4].status, got[4].masked_text) == (200, "x@ex.com")  # its types are all that is masked


@pytest.mark.parametrize("text,values", [
    ("Иванов Пётр Ильич", ["Иванов Пётр Ильич"]), ("Клиент Иванов", []), ("Иванов Петров", []), ("Иванов  Пётр", ["Иванов  Пётр"]), ("Иванов    Пётр", []), ("Смирнов Иванов Петров Анна", ["Иванов Петров Анна"]),
    ("Москва Анна Петровна", ["Анна Петровна"]), ("И. П. Иванову ", ["И. П. Иванову"]), ("Иванов И. П. ", ["Иванов И. П."]), ("И. Москва", []), ("", []),
])
def test_names_of_the_compact_profile(spark, text, values):
    found = spark.createDataFrame([(text,)], "t string").select(compact.names(F.col("t")).alias("c")).first().c
    assert [c.value for c in found] == values


def test_restoring_in_sequence_replaces_again(spark):
    kind = f"array<{compact_masks.MAPPING}>"
    pairs = [("A_1", "<B_1>", "Казань"), ("B_1", "x$1", "Мира")]
    frame = spark.createDataFrame([([(i, "ADDRESS", o, f"<{i}>", s, "", None) for i, o, s in pairs],)], f"m {kind}")
    back = lambda text, mode: frame.select(compact_masks.restored(F.lit(text), mode, F.col("m")).alias("t")).first().t
    assert back("<A_1> и <C_1>", "token") == "x$1 и <C_1>"  # what the first put in is replaced by the second
    assert back("Казань, Казаньх, ул. Мира", "synthetic") == "<B_1>, Казаньх, ул. x$1"
    assert back("<A_1>", "partial") == "<A_1>"


def test_declined_names_get_the_token_in_the_compact_profile(spark):
    kind = "array<struct<type:string,value:string,start:int,end:int,identity_key:string,gender:string,decision:string>>"
    text = "Иванов Пётр и Иванову Петру"
    names = [("FULL_NAME", "Иванов Пётр", 0, 11, "person:иванов пётр", "masc", "MASK"), ("FULL_NAME", "Иванову Петру", 14, 27, "person:иванов пётр", "masc", "MASK")]
    row = compact_masks.masked(spark.createDataFrame([(1, text, names)], f"doc_id int, text string, decisions {kind}"), "synthetic").first()
    first, last = row.mappings[0].synthetic.split(" ")
    assert row.masked_text == f"{first} {last} и <PERSON_1>" and last in compact_masks.LAST and first in compact_masks.FIRST["masc"]
