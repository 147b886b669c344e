import datetime as dt
import hashlib
import json
import time

import pytest
from pyspark.sql import functions as F

from maskfold.operators import entities, synthesis
from maskfold.operators.demask import restored
from maskfold.operators.mask import MODES, masked, put_back
from maskfold.plans import admission
from maskfold.plans.pipelines import analyze, inspect, process, process_batch
from maskfold.sources import tables, vault
from maskfold.streaming.process import configure, process_stream

TEXT = "Клиент Иванов Иван Петрович обратился, паспорт 4510 123456. Позже Ивану Иванову и И. П. Иванову отправили ответ на a.b@ex.com."


@pytest.fixture(scope="module")
def done(spark):
    docs = analyze(spark.createDataFrame([("1", TEXT), ("2", ""), ("3", None)], "id string, text string")).cache()
    return {mode: masked(docs, mode, session="id").cache() for mode in MODES}


def restore(frame, text, mode="synthetic"):
    """A text restored by the mappings of the one row of a frame."""
    return frame.select(restored(F.lit(text), F.lit(mode), F.col("mappings")).alias("back")).first().back


@pytest.mark.parametrize("mode", MODES)
def test_exact_round_trip(done, mode):
    back = done[mode].select("text", put_back(F.col("masked_text"), F.col("occurrences"), True).alias("back"), put_back(F.col("text"), F.col("occurrences"), False).alias("again"), "masked_text")
    assert all(r.back == r.text and r.again == r.masked_text for r in back.collect())


def test_tokens_number_entities(done):
    text = done["token"].where("id = '1'").first().masked_text
    assert text == "Клиент <PERSON_1> обратился, паспорт <PASSPORT_1>. Позже <PERSON_1> и <PERSON_1> отправили ответ на <EMAIL_1>."


def test_surrogates_are_new_stable_and_reversible(done, spark):
    row = done["synthetic"].where("id = '1'").first()
    assert "Иванов" not in row.masked_text and "4510 123456" not in row.masked_text
    assert restore(done["synthetic"].where("id = '1'"), row.masked_text) == TEXT
    again = masked(analyze(spark.createDataFrame([("1", TEXT), ("9", TEXT)], "id string, text string")), "synthetic", session="id").orderBy("id").collect()
    assert again[0].masked_text == row.masked_text != again[1].masked_text


def test_reworded_surrogate_is_restored(done):
    row = done["synthetic"].where("id = '1'").first()
    who = row.mappings[0].synthetic_identity
    said = lambda text: restore(done["synthetic"].where("id = '1'"), text)
    assert said(f"Ответ: {who.first} {who.surname} согласен") == "Ответ: Иван Иванов согласен"
    assert said(f"{who.first[0]}. {who.surname}, {who.surname} {who.first[0]}.{who.patronymic[0]}.") == "И. Иванов, Иванов И. П."
    # whole words only, and a token is put back as well
    assert said(f"x{who.first} {who.surname}y <PERSON_1>") == f"x{who.first} {who.surname}y Иванов Иван Петрович"


def test_restored_text_is_not_replaced_again(spark):
    rows = spark.createDataFrame([("<A_1>", "<A_2>"), ("<A_2>", "x")], "token string, original string").selectExpr("collect_list(struct(token, original)) AS pairs")
    one = "named_struct('entity_id', '', 'type', 'EMAIL', 'original', p.original, 'token', p.token, 'synthetic', p.token, 'partial', '', 'original_nominal', '', 'synthetic_nominal', '', 'grammatical_case', '', 'gender', '', 'aliases', array(''), 'alias_types', array(''), 'original_identity', null, 'synthetic_identity', null, 'synthetic_fallback', '')"
    rows = rows.select(F.expr(f"transform(pairs, p -> {one})").cast(f"array<{entities.MAPPING}>").alias("mappings"))
    assert restore(rows, "<A_1> <A_2>", "token") == "<A_2> x"
    assert restore(rows, "<A_1> <A_2><A_1", "synthetic") == "<A_2> x<A_1"
    assert restore(rows, "**", "partial") == "**"


def mention(start, *parts, gender="masc"):
    rows = [{"kind": k, "surface": w, "offset_start": 0, "offset_end": 0, "role": r, "normalized": w if k == "word" else None, "letter": w[0] if k == "initial" else None} for k, w, r in parts]
    return {"start": start, "meta": {"name_parts": rows, "gender": gender, "alias_type": "FULL"}}


def test_resolution_is_cautious():
    full = mention(0, ("word", "иванов", "surname"), ("word", "иван", "first"))
    same = mention(10, ("word", "иван", "first"), ("word", "иванов", "surname"))
    other = mention(20, ("word", "иванов", "surname"), ("word", "пётр", "first"))
    initials = mention(30, ("initial", "И.", "first"), ("word", "иванов", "surname"))
    surname = mention(40, ("word", "иванов", "surname"))
    woman = mention(50, ("word", "иванов", "surname"), ("word", "иван", "first"), gender="femn")
    keys = [r[1].rsplit("#")[1] for r in entities.resolve([full, same, other, initials, surname, woman])]
    assert keys == ["1", "1", "2", "1", "3", "4"]


def draw(seed, counter, n):
    return int.from_bytes(hashlib.sha256(f"{seed}:{counter}".encode()).digest()[:8], "big") % n


def test_draws_follow_the_stream(spark):
    moduli = [2, 10, 1000, 23376, 1 << 30]
    row = spark.range(1).select(synthesis.draws(F.lit("99"), F.array(*[F.lit(n) for n in moduli]), F.lit(3)).alias("d")).first()
    assert row.d.xs == [draw(99, 3 + i, n) for i, n in enumerate(moduli)] and row.d.counter == 8


def test_surrogates_of_each_type_keep_their_shape(spark):
    kinds = [("CARD_NUMBER", "0000-0000-0000-0000"), ("INN", "0" * 12), ("PHONE", "+7 900 000-00-00"), ("BIRTH_DATE", "2000-01-02"), ("NOTHING", "x"), ("PASSPORT", "no digit")]
    frame = spark.createDataFrame(kinds, "kind string, value string")
    got = {r.kind: r.s for r in frame.select("kind", synthesis.surrogate(F.col("kind"), F.col("value"), F.lit(None).cast("string"), F.lit("7")).alias("s")).collect()}
    card = got["CARD_NUMBER"].replace("-", "")
    assert len(got["CARD_NUMBER"]) == 19 and sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(card)) % 10 == 0
    assert len(got["INN"]) == 12 and got["PHONE"].startswith("+7 ") and got["BIRTH_DATE"][4] == "-"
    assert got["NOTHING"] is None and got["PASSPORT"] == "no digit"


def test_no_free_surrogate_gives_the_token(spark):
    text = "гражданство: " + ", ".join(synthesis.fv.COUNTRIES)
    row = masked(analyze(spark.createDataFrame([("1", text)], "id string, text string"), only=("citizenship",)), "synthetic", session="id", names=False).first()
    assert [(x.synthetic, x.synthetic_fallback) for x in row.mappings] == [("<CITIZENSHIP_1>", "token")] and "<CITIZENSHIP_1>" in row.masked_text


def test_inspect(spark):
    row = inspect(spark.createDataFrame([(TEXT,)], "text string"), "token").first()
    assert row.n_detected == 5 and row.round_trip_ok is False  # tokens restore the first surface of a name
    assert inspect(spark.createDataFrame([(TEXT,)], "text string"), "partial").first().round_trip_ok is None


def test_process_in_batch(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    first = masked(analyze(spark.createDataFrame([("a", TEXT)], "payload_id string, payload string"), "payload"), "token", "payload", session="payload_id")
    records = vault.records(first, "payload", now)
    hidden = first.first().masked_text
    rows = [("a", TEXT, True), ("b", "почта x@ex.com", True), ("a", hidden, True), ("a", "Re: " + hidden, True), ("a", hidden, False)]
    out = process(spark.createDataFrame(rows, "payload_id string, payload string, allow_demask boolean"), records, "token", now)
    got = {(r.payload, r.direction): r.result for r in out.collect() if r.payload != hidden}
    assert got[(TEXT, "retry_mask")] == hidden
    assert got[("почта x@ex.com", "mask")] == "почта <EMAIL_1>"
    assert got[("Re: " + hidden, "demask")].startswith("Re: Клиент Иванов Иван Петрович")
    assert sorted(r.result == TEXT for r in out.collect() if r.payload == hidden) == [False, True]


def test_vault_states(spark):
    at = lambda n: F.lit(dt.datetime(2024, 1, 1) + dt.timedelta(seconds=n)).cast("timestamp")
    first = masked(analyze(spark.createDataFrame([("a", "x@ex.com")], "payload_id string, payload string"), "payload", only=("email",)), "token", "payload", names=False)
    table = vault.insert_if_absent(vault.records(first, "payload", at(0)).where("false"), vault.records(first, "payload", at(0)), at(0))
    assert table.count() == 1 and "payload" not in table.columns
    turned = vault.mark_demasked(table, spark.createDataFrame([("a",)], "payload_id string"), at(100))
    again = vault.mark_demasked(turned, spark.createDataFrame([("a",)], "payload_id string"), at(120))
    assert again.first().state == vault.GRACE and vault.live(again, at(159)).count() == 1 and vault.live(again, at(160)).count() == 0


def test_policies(spark, tmp_path):
    known = tables.with_policy(spark.createDataFrame([(None,), ("chat-assistant",), ("x",)], "consumer_id string"), tables.policies(spark))
    assert {r.consumer_id: r.error_category for r in known.collect()} == {None: None, "chat-assistant": None, "x": "not_found"}
    assert tables.policies_from_yaml(spark, str(tmp_path / "none")).collect()[0].masking_mode == "partial"
    assert tables.scrubbed(spark.createDataFrame([("a", "b")], "id string, payload string")).columns == ["id"]


def test_stream_masks_then_restores(spark, tmp_path):
    configure(spark)
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()

    def send(n, rows):
        (folder / f"{n}.json").write_text("\n".join(json.dumps({"payload_id": i, "seq": s, "payload": p}, ensure_ascii=False) for i, s, p in rows), encoding="utf-8")
        stream = spark.readStream.schema("payload_id string, seq bigint, payload string").json(str(folder))
        q = process_stream(stream, "token").writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        try:
            assert q.awaitTermination(120)
        finally:
            q.stop()
        return {(r.payload_id, r.seq): (r.direction, r.status, r.result) for r in spark.read.parquet(str(out)).collect()}

    got = send(1, [("a", 1, "почта x@ex.com"), ("b", 1, "нет данных"), ("b", 2, "другой текст")])
    assert got[("a", 1)] == ("mask", 200, "почта <EMAIL_1>") and got[("b", 2)][1] == 409
    got = send(2, [("a", 2, "почта x@ex.com"), ("a", 3, "почта <EMAIL_1>"), ("a", 4, "адрес <EMAIL_1>!")])
    assert got[("a", 2)] == ("retry_mask", 200, "почта <EMAIL_1>")
    assert got[("a", 3)] == ("demask", 200, "почта x@ex.com") and got[("a", 4)] == ("demask", 200, "адрес x@ex.com!")


def test_admission_gate_and_breaker(spark):
    log = spark.createDataFrame([("w", 1, "acquire", 1, 10), ("w", 2, "acquire", 2, 10), ("w", 3, "acquire", 3, 10), ("w", 4, "release", 1, 10), ("w", 5, "acquire", 4, 10), ("w", 6, "acquire", 5, 99999)], "worker string, seq bigint, event string, request bigint, payload_size bigint")
    out = admission.admission_gate(log, max_in_flight=2, max_backlog=5000.0).orderBy("seq").collect()
    assert [(r.admitted, r.reason) for r in out] == [(True, None), (True, None), (False, "in_flight_limit"), (None, None), (True, None), (False, "in_flight_limit")]
    t = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=n)
    outcomes = spark.createDataFrame([("m", 1, t(0), False), ("m", 2, t(1), False), ("m", 3, t(2), False), ("m", 4, t(3), True), ("m", 5, t(13), False), ("m", 6, t(14), True), ("m", 7, t(24), True), ("m", 8, t(25), True)], "backend string, seq bigint, ts timestamp, ok boolean")
    assert [r.state for r in admission.breaker_states(outcomes).orderBy("seq").collect()] == ["closed", "closed", "closed", "open", "half_open", "open", "half_open", "closed"]


def test_without_vault_fails_closed(spark):
    from maskfold.plans.pipelines import status_of_error, without_vault

    texts = ["просто текст", "почта x@ex.com", "ответ <EMAIL_1>", "карта 0000 **** 11"]
    out = without_vault(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "payload_id string, payload string")).collect()
    assert [(r.status, r.result) for r in sorted(out, key=lambda r: r.payload_id)] == [(200, texts[0]), (503, None), (503, None), (503, None)]
    kinds = spark.createDataFrame([(None,), ("conflict",), ("odd",)], "k string").select(status_of_error(F.col("k")).alias("s"))
    assert [r.s for r in kinds.collect()] == [200, 409, 500]


def test_sql_functions(spark):
    from maskfold.sources import sql

    sql.register(spark)
    row = spark.sql("SELECT pii_token_count('abcdefgh') AS n, pii_luhn_valid('0000 0000') AS ok, pii_mask_alnum('а-1') AS m, pii_fingerprint('x') AS f").first()
    assert (row.n, row.ok, row.m, len(row.f)) == (2, True, "*-*", 64)
    names = spark.sql("SELECT n.value, n.nominal FROM (SELECT 'Письмо Ивану Иванову' AS t) d, LATERAL pii_names(d.t) n").collect()
    assert [tuple(r) for r in names] == [("Ивану Иванову", "Иван Иванов")]


def test_gate_turns_away_under_critical_memory_first(spark):
    log = spark.createDataFrame([(1, i, "acquire", i, 100, rss) for i, rss in enumerate([100.0, 13000.0, 100.0, 100.0])], "worker long, seq long, event string, request long, payload_size long, rss_mb double")
    out = admission.admission_gate(log, max_in_flight=2).orderBy("seq").collect()
    assert [(r.admitted, r.reason) for r in out] == [(True, None), (False, "critical_pressure"), (True, None), (False, "in_flight_limit")]


def test_folds_hold_one_key_at_a_time_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        log = spark.createDataFrame([(k % 3, k, "acquire", k, 10) for k in range(40)], "worker long, seq long, event string, request long, payload_size long")
        out = admission.admission_gate(log, max_in_flight=5).collect()
        assert len(out) == 40 and sum(r.admitted for r in out) == 15
        rates = admission.smoothed_rate(spark.sql("select id % 3 as u, timestamp_seconds(id) as ts, 1.0D as v from range(30)"), "u", "ts", "v").collect()
        assert {(r.u, r.n) for r in rates} == {(0, 10), (1, 10), (2, 10)}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_batch_goes_over_to_grace(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    empty = spark.createDataFrame([], f"payload_id string, {vault.RECORD}")
    one = spark.createDataFrame([("a", "mail a.b@ex.com", 1, None), ("a", "mail a.b@ex.com", 2, None), ("a", "other", 3, None), ("", "x", 4, None), ("b", None, 5, None), ("c", "x", 6, "nobody")], "payload_id string, payload string, seq long, consumer_id string")
    answers, held = process_batch(one, empty, tables.policies(spark), now, only=("email",), modes=("partial",))
    assert {r.seq: r.status for r in answers.collect()} == {1: 200, 2: 200, 3: 409, 4: 422, 5: 422, 6: 404}
    masked_text = answers.where("seq = 1").first().result
    assert masked_text == "mail *.*@**.***" and held.count() == 1
    two = spark.createDataFrame([("a", masked_text, 7, None)], one.schema)
    told, after = process_batch(two, held, tables.policies(spark), now + F.make_dt_interval(secs=F.lit(5)), only=("email",), modes=("partial",))
    assert told.first().result == "mail a.b@ex.com"
    row = after.first()
    assert row.state == vault.GRACE and row.expires_at == dt.datetime(2024, 1, 1, 0, 1, 5)


def test_policies_of_a_file(spark, tmp_path):
    path = tmp_path / "consumers.yaml"
    path.write_text("default: {masking_mode: token}\nconsumers:\n  a: {enabled: false, mask_types: [EMAIL]}\n  b: {mask_types: []}\n")
    rows = {r.consumer_id: (r.enabled, r.demask, r.masking_mode, r.mask_types) for r in tables.policies_from_yaml(spark, str(path)).collect()}
    assert rows == {"default": (True, True, "token", None), "a": (False, True, "partial", ["EMAIL"]), "b": (True, True, "partial", [])}


def test_long_document_with_thousands_of_entities(spark):
    """190,000 characters as one row: numbering and grouping of its entities go through sorted arrays and maps."""
    text = " ".join(f"Текст номер {i} почта u{i % 2500}@ex.com и слова, слова до конца." for i in range(3200))
    assert len(text) > 190_000
    began = time.perf_counter()
    done = masked(analyze(spark.createDataFrame([("1", text)], "id string, text string"), only=("email",)), "token", names=False)
    row = done.select("mappings", F.size("occurrences").alias("n"), (put_back(F.col("masked_text"), F.col("occurrences"), True) == F.col("text")).alias("exact")).first()
    assert row.n == 3200 and row.exact and len(row.mappings) == 2500 and row.mappings[2499].token == "<EMAIL_2500>" and row.mappings[7].original == "u7@ex.com"
    assert time.perf_counter() - began < 90
