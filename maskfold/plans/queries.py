"""Registered queries of the privacy engine, one or more for each operator, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import scalars as s
from ..functions.scalars import built
from ..functions.spans import find_spans
from ..operators import compact as cp
from ..operators import compact_masks as cm
from ..operators import decide as dc
from ..operators import detectors as dt
from ..operators import entities as en
from ..operators import mask as mk
from ..operators.demask import restored, restored_tokens
from ..sources import tables as src
from ..sources import vault as vt
from ..sources.names_corpus import names_corpus
from ..sources.shared import new_path, written
from ..sources.vault_sink import VaultSink, vault_stream
from . import admission as ad
from . import pipelines as pl

RU = f"ru AS ({src.RU_CORPUS_SQL})"
FLAGSHIP = ("email", "card", "inn")


def rows_of(found: DataFrame, column: str = "candidates", extra: tuple[str, ...] = ()) -> DataFrame:
    """One row for each element of an array of candidates or decisions."""
    return found.select("doc_id", F.explode(column).alias("c")).select("doc_id", "c.type", "c.value", "c.start", "c.end", F.round("c.confidence", 2).alias("confidence"), *[f"c.{e}" for e in extra])


def _detector(name: str, on: str = "ru") -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = src.ru_corpus(spark, sf_dir) if on == "ru" else src.table(spark, sf_dir, on)
        return rows_of(dt.detect(docs.select("doc_id", "text"), only=(name,)))

    return query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail addresses, cards and taxpayer numbers of ``documents`` masked in part, with a fingerprint. No Python runs."""
    docs = src.table(spark, sf_dir, "documents").select("doc_id", "text")
    done = mk.masked(pl.analyze(docs, only=FLAGSHIP), "partial", names=False)
    return done.select("doc_id", F.col("n_masked").alias("n_found"), "masked_text", s.fingerprint(F.col("text")).alias("fingerprint"))


# --- scalars ---


def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    c = src.table(spark, sf_dir, "customer").select("c_custkey", F.lpad(((k * 7919 + 13) % 10000000000000).cast("string"), 16, "0").alias("card"), F.lpad(((k * 104729) % 10000000000).cast("string"), 10, "0").alias("inn10"), F.lpad(((k * 1000003) % 1000000000000).cast("string"), 12, "0").alias("inn12"))
    return c.select("c_custkey", s.luhn_valid(F.col("card")).alias("luhn"), s.inn_valid(F.col("inn10")).alias("inn10"), s.inn_valid(F.col("inn12")).alias("inn12"))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return src.table(spark, sf_dir, "documents").select("doc_id", s.fingerprint(t).alias("plain"), s.fingerprint(t, "key").alias("keyed"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(s.token_count(F.col("text"))).alias("tokens"), F.count("*").alias("documents"))


def partial_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    raw = F.concat(F.lpad((k % 10000).cast("string"), 4, "0"), F.lit(" "), F.lpad((k * 7919 % 1000000).cast("string"), 6, "0"))
    mask = lambda kind, value: s.partial_mask(F.lit(kind), value)
    return src.table(spark, sf_dir, "customer").select(
        "c_custkey", mask("PASSPORT", raw).alias("passport"), mask("PHONE", F.concat(F.lit("+7 "), raw)).alias("phone"), mask("CARD_NUMBER", F.concat(raw, F.lit("-"), raw)).alias("card"),
        mask("INN", raw).alias("inn"), mask("PIN", raw).alias("other"), mask("FULL_NAME", F.col("c_name")).alias("name"), mask("EMAIL", F.concat(F.lit("a"), k.cast("string"), F.lit("@ex.com"))).alias("email"),
        s.normalize_ru_phone(F.concat(F.lit("8 "), raw)).alias("normalized"),
    )


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = s.entity_seed(F.col("c_custkey").cast("string"), F.concat(F.lit("EMAIL:"), F.col("c_name")))
    return src.table(spark, sf_dir, "customer").select("c_custkey", seed.cast("string").alias("seed"), s.draw(seed, 0, 16).alias("draw"))


# --- overlaps, context, policy ---


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates made from orders: many that overlap for each customer."""
    o = src.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    c = F.struct(F.lit("PIN").alias("type"), k.cast("string").alias("value"), (k * 13 % 97).cast("int").alias("start"), (k * 13 % 97 + 3 + k % 11).cast("int").alias("end"), F.lit("own").alias("detector"), ((k % 4 + 5) / 10.0).alias("confidence"), (k % 1000003).cast("int").alias("det_order"), F.lit(None).cast(dt.META).alias("meta")).cast(dt.CANDIDATE)
    return o.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.collect_list(c).alias("candidates"))


def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = _intervals(spark, sf_dir).withColumn("candidates", dc.resolve_overlaps(F.col("candidates")))
    return rows_of(chosen).select("doc_id", "value", "start", "end")


def sentence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence around each number of ``documents``, wherever it stands."""
    docs = src.table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(find_spans(F.col("text"), "[0-9]+")).alias("s"))
    b = docs.withColumn("b", dc.sentence_bounds(F.col("text"), F.col("s.start"), F.col("s.end")))
    return b.select("doc_id", "s.start", "b.low", "b.high")


def keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.lower("text")
    groups = ((fv.ROLES, "role"), (fv.ACTIONS, "action"), (fv.STRONG_PII, "strong_pii"), (fv.PUBLIC_MARKERS, "public_marker"))
    found = F.concat(*[dc.hits(w, words, prefix) for words, prefix in groups])
    return src.ru_corpus(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(found), ",").alias("hits"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pl.analyze(src.ru_corpus(spark, sf_dir)).select("doc_id", F.explode("decisions").alias("d"))
    return out.select("doc_id", "d.type", "d.value", "d.start", "d.end", F.round("d.confidence", 2).alias("confidence"), "d.decision", F.array_join("d.reasons", ",").alias("reasons"))


def decisions_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of addresses and PINs, whose context needs no morphology."""
    out = pl.analyze(src.ru_corpus(spark, sf_dir), only=("address", "pin", "card"))
    return out.select("doc_id", F.explode("decisions").alias("d")).select("doc_id", "d.type", "d.start", "d.decision", F.round("d.decision_confidence", 2).alias("confidence"), F.array_join("d.reasons", ",").alias("reasons"))


def consumer_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of several consumers, some unknown: who is answered, and which types are masked."""
    c = src.table(spark, sf_dir, "customer")
    pick = F.get(F.array(F.lit(None), F.lit("chat-assistant"), F.lit("analytics-pipeline"), F.lit("nobody")), (F.col("c_custkey") % 4).cast("int"))
    requests = src.ru_corpus(spark, sf_dir).join(c.select(F.col("c_custkey").alias("doc_id"), pick.alias("consumer_id")), "doc_id")
    known = src.with_policy(requests, src.policies(spark))
    out = pl.analyze(known.where("error_category is null"), only=("email", "inn", "pin", "card", "cvv"), mask_types=F.col("mask_types"))
    per = out.groupBy("consumer_id").agg(F.count("*").alias("requests"), F.sum(F.size(F.filter("decisions", lambda d: d["decision"] == "MASK"))).alias("masked"), F.sum(F.size("decisions")).alias("found"))
    refused = known.where("error_category is not null").groupBy("consumer_id").agg(F.count("*").alias("requests"), F.lit(0).cast("bigint").alias("masked"), F.lit(0).cast("bigint").alias("found"))
    return per.unionByName(refused)


# --- entities, masks, restoring ---

_NO_NAMES = ("email", "phone", "inn", "card", "citizenship", "department_code")


def token_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of structured types with their tokens, several texts to a document."""
    ru = src.ru_corpus(spark, sf_dir)
    docs = ru.groupBy(F.floor(F.col("doc_id") / 40).alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]), "\n").alias("text"))
    out = mk.masked(pl.analyze(docs, only=_NO_NAMES), "token", names=False)
    return out.select("doc_id", F.explode("mappings").alias("m")).select("doc_id", "m.entity_id", "m.type", "m.original", "m.token", "m.partial", F.size("m.aliases").alias("n_aliases"))


def token_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mk.masked(pl.analyze(src.ru_corpus(spark, sf_dir), only=_NO_NAMES), "token", names=False)
    exact = mk.put_back(F.col("masked_text"), F.col("occurrences"), True)
    return out.select("doc_id", "masked_text", exact.alias("exact"), restored_tokens(F.col("masked_text"), F.col("mappings")).alias("restored"))


def partial_mask_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mk.masked(pl.analyze(src.ru_corpus(spark, sf_dir)), "partial")
    return pl.exact_round_trip(out).select("doc_id", "masked_text", "n_detected", "n_masked", "restored_exactly")


def _synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = src.ru_corpus(spark, sf_dir).withColumn("session", F.col("doc_id").cast("string"))
    return mk.masked(pl.analyze(docs), "synthetic", session="session")


def surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands for each occurrence, and its entity's surrogate."""
    found = _synthetic(spark, sf_dir).select("doc_id", F.explode("occurrences").alias("x"), "mappings")
    entity = F.get(F.filter("mappings", lambda y: y["entity_id"] == F.col("x.entity_id")), F.lit(0))
    return found.select("doc_id", "x.entity_id", entity["type"].alias("type"), F.col("x.original_start").alias("start"), F.col("x.original").alias("value"), entity["synthetic"].alias("synthetic"), F.col("x.masked").alias("new"))


def synthetic_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surrogates for all types: the masked text, whether a value stands for itself, and what both ways of restoring give."""
    out = _synthetic(spark, sf_dir)
    back = restored(F.col("masked_text"), F.lit("synthetic"), F.col("mappings"))
    leaks = F.exists("occurrences", lambda x: x["masked"] == x["original"])
    return pl.exact_round_trip(out).select("doc_id", "n_masked", "masked_text", leaks.alias("leaks"), "restored_exactly", back.alias("restored"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons of each text: mentions of one person share a key."""
    out = pl.analyze(src.ru_corpus(spark, sf_dir), only=("fio",)).withColumn("p", F.explode(en.people(F.col("decisions"))))
    return out.groupBy("doc_id", "p.key").agg(F.count("*").alias("mentions"), F.first("p.surname").alias("surname"), F.first("p.first").alias("first"), F.first("p.patronymic").alias("patronymic"))


def inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pl.inspect(src.ru_corpus(spark, sf_dir), "token")
    return out.select("doc_id", "n_detected", "n_masked", "masked_text", "demasked", "round_trip_ok", F.size("mappings").alias("n_mappings"))


def inspect_consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts explained for several consumers and modes, some of which there are not."""
    k = F.col("doc_id")
    mode = F.get(F.array(F.lit("token"), F.lit("partial"), F.lit("bogus"), F.lit("token"), F.lit(None)), (k % 5).cast("int"))
    consumer = F.get(F.array(F.lit(None), F.lit("chat-assistant"), F.lit("analytics-pipeline"), F.lit("nobody")), (F.floor(k / 20) % 4).cast("int"))
    out = pl.inspect_requests(src.ru_corpus(spark, sf_dir).withColumn("mode", mode).withColumn("consumer_id", consumer), src.policies(spark))
    kept = F.array_join(F.transform(F.filter("decisions", lambda d: F.array_contains(d["reasons"], "consumer_policy_excludes_type")), lambda d: d["type"]), ",")
    none = F.lit("")
    return out.select(
        "doc_id", "mode", "status", F.coalesce("error", none).alias("error"), F.coalesce("masked_text", none).alias("masked_text"), F.coalesce("demasked", none).alias("demasked"),
        F.coalesce(F.col("round_trip_ok").cast("string"), none).alias("round_trip_ok"), F.coalesce("n_detected", F.lit(-1)).alias("n_detected"), F.coalesce("n_masked", F.lit(-1)).alias("n_masked"), F.coalesce(kept, none).alias("excluded"),
    )


def _name_rows(docs: DataFrame) -> DataFrame:
    out = dt.detect(docs, only=("fio",))
    return out.select("doc_id", F.explode("candidates").alias("c")).select("doc_id", "c.value", "c.start", "c.end", "c.confidence", "c.meta.gram_case", "c.meta.gender", "c.meta.nominal_form", "c.meta.alias_type", "c.meta.known_public_figure")


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _name_rows(src.ru_corpus(spark, sf_dir))


def name_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in all orders, cases and genders, with initials, and with surnames that no list knows."""
    return _name_rows(names_corpus(spark, sf_dir))


# --- vault and process ---


def vault_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Save-if-absent of events as records: the first event of a user wins, unless it has expired by the second batch."""
    e = src.table(spark, sf_dir, "events")
    null = F.lit(None)
    new = e.select(F.col("user_id").cast("string").alias("payload_id"), F.col("event_id").cast("string").alias("original_fingerprint"), F.col("ts").cast("timestamp").alias("created_at"), (F.col("ts").cast("timestamp") + F.make_dt_interval(secs=F.lit(600))).alias("expires_at"), (F.col("event_id") % 2).alias("batch"), null.cast("string").alias("mode"))
    now = F.lit("2024-01-15").cast("timestamp")
    first = vt.insert_if_absent(new.where("false").drop("batch"), new.where("batch = 0").drop("batch"), now)
    second = vt.insert_if_absent(first, new.where("batch = 1").drop("batch"), now)
    return second.select("payload_id", "original_fingerprint")


#: Micro-batches that the log of events is dealt to, and the times to live there, as its users come back after hours.
LOG_PARTS, LOG_TTL, LOG_GRACE = 6, 3 * 86_400, 6 * 3_600
#: Files of a micro-batch, dealt by key, so that it is written and read by several tasks; and how far its share of the log may be off, which changes no result.
LOG_FILES, LOG_ERROR = 12, 0.001


def vault_stream_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of events merged into a vault: purchases and signups save records, other events restore from them. What is live at the end."""
    e = src.table(spark, sf_dir, "events")
    save = F.col("event_type").isin("purchase", "signup")
    log = e.select(F.col("user_id").cast("string").alias("payload_id"), F.col("event_id").alias("seq"), F.when(save, "save").otherwise("demask").alias("op"), F.col("ts").cast("timestamp").alias("at"), F.lit("token").alias("mode"))
    where, last = new_path(spark, "vault-log"), None
    # an exact quantile would hold the whole log in the driver
    for upto in [*log.approxQuantile("seq", [k / LOG_PARTS for k in range(1, LOG_PARTS)], LOG_ERROR), None]:
        part = (F.lit(True) if last is None else F.col("seq") > last) & (F.lit(True) if upto is None else F.col("seq") <= upto)
        # a key's changes of one part stand in one file, so that they stay in order even where a part has fewer files
        log.where(part).repartition(LOG_FILES, "payload_id").write.mode("append").parquet(where)
        last = upto
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", LOG_FILES).parquet(where)
    sink = VaultSink(spark, new_path(spark, "vault"), LOG_TTL, LOG_GRACE, compact_every=4)
    vault_stream(stream, sink, new_path(spark, "vault-checkpoint")).awaitTermination(3600)
    now = e.agg(F.max("ts").cast("timestamp").alias("now")).first().now
    held = sink.vault().where(F.col("expires_at") > F.lit(now))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return held.select("payload_id", "seq", "state", "mode", stamp("expires_at").alias("expires_at"), F.coalesce(stamp("demasked_at"), F.lit("")).alias("demasked_at"))


def process_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second round of requests against the first round's records: known, masked, reworded and new texts."""
    now = F.lit("2024-01-01").cast("timestamp")
    docs = src.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("payload_id"), F.col("text").alias("payload"))
    done = written(mk.masked(pl.analyze(docs, "payload", only=FLAGSHIP), "token", "payload", names=False), "masked")
    vault = vt.records(done, "payload", now)
    k = F.col("payload_id").cast("bigint") % 4
    again = done.select(
        F.when(k == 3, F.concat(F.lit("new"), "payload_id")).otherwise(F.col("payload_id")).alias("payload_id"),
        F.when(k == 0, F.col("payload")).when(k == 1, F.col("masked_text")).otherwise(F.concat(F.lit("Re: "), "masked_text")).alias("payload"),
        F.lit(True).alias("allow_demask"),
    )
    told = pl.process(again, vault, "token", now, only=FLAGSHIP)
    return told.select("payload_id", "direction", F.sha2("result", 256).alias("result"))


#: Characters that a payload may have in this batch.
MOST = 3_000


def process_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of first requests with repeats, conflicts, missing ids, long payloads and unknown consumers."""
    now = F.lit("2024-01-01").cast("timestamp")
    docs, k = src.table(spark, sf_dir, "documents"), F.col("doc_id")
    base = docs.select(k.cast("string").alias("id"), F.col("text").alias("payload"), k.alias("k"))
    consumer = F.when(F.col("k") % 5 == 0, "nobody")
    one = base.select(F.when(F.col("k") % 7 == 0, "").otherwise(F.col("id")).alias("payload_id"), "payload", (2 * F.col("k")).alias("seq"), consumer.alias("consumer_id"))
    two = base.where("k % 3 < 2").select(F.col("id").alias("payload_id"), F.when(F.col("k") % 3 == 0, F.col("payload")).otherwise(F.lit("another")).alias("payload"), (2 * F.col("k") + 1).alias("seq"), consumer.alias("consumer_id"))
    requests = one.unionByName(two)
    vault = spark.createDataFrame([], f"payload_id string, {vt.RECORD}")
    answers, _ = pl.process_batch(requests, vault, src.policies(spark), now, only=FLAGSHIP, modes=("partial",), max_payload=MOST)
    return answers.select("payload_id", "seq", F.coalesce("direction", F.lit("")).alias("direction"), "status", F.sha2(F.coalesce("result", F.lit("")), 256).alias("result"))


# --- the compact profile ---


def compact_spans(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...]) -> DataFrame:
    found = cp.detect(src.ru_corpus(spark, sf_dir), only=kinds).select("doc_id", F.explode("candidates").alias("c"))
    return found.select("doc_id", "c.type", "c.value", "c.start", "c.end")


def _compact(*kinds: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: compact_spans(spark, sf_dir, kinds)


def compact_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cp.decide(cp.detect(src.ru_corpus(spark, sf_dir))).select("doc_id", F.explode("decisions").alias("d"))
    return out.select("doc_id", "d.type", "d.start", "d.end", "d.decision", "d.reason", cp.partial_mask(F.col("d.type"), F.col("d.value")).alias("partial"))


def compact_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = names_corpus(spark, sf_dir).select("doc_id", F.explode(built(lambda: cp.names(F.col("text")), "compact names")).alias("c"))
    return found.select("doc_id", "c.value", "c.start", "c.end", "c.identity_key", F.coalesce("c.gender", F.lit("")).alias("gender"))


def compact_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compact profile's surrogates, and what its restoring makes of a reworded text, one replacement after the other."""
    out = cm.masked(cp.decide(cp.detect(src.ru_corpus(spark, sf_dir))), "synthetic")
    again = F.concat(F.lit("Re: "), "masked_text")
    return out.select("doc_id", "masked_text", cm.restored(again, "synthetic", F.col("mappings")).alias("restored"))


# --- operations ---


def admission_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = src.table(spark, sf_dir, "documents").select("doc_id", (F.octet_length("text") * 300).alias("size"))
    status, wait = ad.status_of(F.col("size"), F.col("size") % 3 > 0, F.lit(1.5) * (F.col("doc_id") % 7))
    return e.select("doc_id", ad.work(F.col("size")).alias("work"), status.alias("status"), F.coalesce(wait.cast("bigint"), F.lit(0)).alias("retry_after"))


def load_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = src.table(spark, sf_dir, "events"), F.col("event_id")
    state = ad.load_state((k * 37 % 13000).cast("double"), k % 11 == 0, (k % 35).cast("int"), (k * 1009 % 4000000).cast("double"), k % 5 == 0)
    wait = ad.retry_after((k * 1009 % 400000).cast("double"), F.lit(900.0), (k % 50 * 100).cast("double"), (k % 70 * 90).cast("double"), F.lit(0.25), k % 11 == 0)
    return e.select("event_id", state.alias("state"), wait.alias("retry_after"))


def smoothed_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = src.table(spark, sf_dir, "events").where("ts is not null and value is not null").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    return ad.smoothed_rate(log, "user_id", "ts", "value").select("user_id", "n", F.round("rate", 6).alias("rate"))


def breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = src.table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("backend"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") * 7919 % 10 < 4).alias("ok"))
    return ad.breaker_states(log)


def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = src.table(spark, sf_dir, "events"), F.col("event_id")
    releases = k % 3 == 2
    log = e.select(
        (F.col("user_id") % 50).alias("worker"), k.alias("seq"), F.when(releases, "release").otherwise("acquire").alias("event"), (k - F.when(releases, 2).otherwise(0)).alias("request"),
        (k * 31 % 5000).alias("payload_size"), (k * 37 % 12500).cast("double").alias("rss_mb"),
    )
    return ad.admission_gate(log, max_in_flight=6, max_backlog=20_000.0).fillna(False, "admitted").fillna("", "reason")


def request_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = src.table(spark, sf_dir, "events"), F.col("event_id")
    direction = F.get(F.array(F.lit("mask"), F.lit("retry_mask"), F.lit("demask")), (k % 3).cast("int"))
    status = F.when(k % 17 == 0, 429).when(k % 23 == 0, 503).when(k % 29 == 0, 409).otherwise(200)
    answers = e.select(direction.alias("direction"), status.alias("status"), (k % 64 / F.lit(64.0)).alias("seconds"), F.when(status == 429, k % 31).alias("retry_after"), (k % 900).alias("tokens"))
    return ad.request_metrics(answers)


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = src.table(spark, sf_dir, "events"), F.col("event_id")
    load = e.select((F.col("user_id") % 50).alias("worker"), F.when(k % 5 == 0, "OVERLOADED").otherwise("CACHE_DEGRADED").alias("state"))
    last = breaker(spark, sf_dir).groupBy("backend").agg(F.max_by("state", "seq").alias("state"))
    return ad.health(load, last)


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = src.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    done = mk.masked(pl.analyze(docs, only=("email",)), "token", names=False).withColumn("tokens", s.token_count(F.col("text")))
    return ad.service_metrics(done, ["lang"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "flagship_mask": flagship,
    "c01_checksums": checksums,
    "c03_fingerprints": fingerprints,
    "c05_token_counts": token_counts,
    "c06_partial_masks": partial_masks,
    "c15_seeds": seeds,
    "d01_email": _detector("email", "documents"),
    "d02_phone": _detector("phone"),
    "d04_inn": _detector("inn"),
    "d04_inn_documents": _detector("inn", "documents"),
    "d05_card": _detector("card"),
    "d05_card_documents": _detector("card", "documents"),
    "d06_passport": _detector("passport"),
    "d09_department_code": _detector("department_code"),
    "d10_cvv": _detector("cvv"),
    "d11_pin": _detector("pin"),
    "d12_driver_license": _detector("driver_license"),
    "d13_dates": _detector("date"),
    "d14_cardholder": _detector("cardholder"),
    "d15_address": _detector("address"),
    "d16_birth_place": _detector("birth_place"),
    "d17_citizenship": _detector("citizenship"),
    "d18_passport_issuer": _detector("passport_issuer"),
    "d19_names": names,
    "n02_name_forms": name_forms,
    "e01_people": people,
    "e08_token_entities": token_entities,
    "m02_token_round_trip": token_round_trip,
    "m03_synthetic_round_trip": synthetic_round_trip,
    "o1_overlaps": overlaps,
    "p01_decisions_structured": decisions_structured,
    "p04_consumer_policies": consumer_policies,
    "r05_partial_mask_all": partial_mask_all,
    "s02_inspect": inspect,
    "s02_inspect_consumers": inspect_consumers,
    "s05_vault_inserts": vault_inserts,
    "s06_vault_stream": vault_stream_of_events,
    "t01_process_directions": process_directions,
    "t02_process_batch": process_batch,
    "x01_sentence_windows": sentence_windows,
    "x03_keyword_hits": keyword_hits,
    "x06_decisions": decisions,
    "g01_surrogates": surrogates,
    "g01_compact_decisions": compact_decisions,
    "g08_compact_names": compact_names,
    "g12_compact_surrogates": compact_surrogates,
    "g03_compact_inn": _compact("INN"),
    "g04_compact_codes": _compact("CVV", "PIN"),
    "g05_compact_dates": _compact("BIRTH_DATE", "PASSPORT_ISSUE_DATE"),
    "g06_compact_address": _compact("ADDRESS"),
    "g07_compact_named": _compact("PASSPORT_ISSUER", "CITIZENSHIP", "CARDHOLDER"),
    "a01_admission_work": admission_work,
    "a02_admission_gate": gate,
    "a03_load_states": load_states,
    "a05_smoothed_rates": smoothed_rates,
    "a07_breaker": breaker,
    "a09_metrics": metrics,
    "a09_request_metrics": request_metrics,
    "a10_health": health,
}

