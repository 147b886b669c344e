"""Admission control, load states, health and service metrics as analytics over logs.

What decides from one event to the next (limits, smoothed rates, breakers) is an ordered fold over the events of one
worker, user or backend. Logs are dealt by that key and sorted, and each task goes through its part once, holding
the state of one key: a log of any length needs the memory of its open requests. All else is plain grouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.folds import folded

# The service's defaults.
BASE_COST, PER_CHAR = 500.0, 1.0
MAX_IN_FLIGHT, MAX_BACKLOG = 32, 4_000_000.0
MAX_PAYLOAD = 3_000_000
MIN_RETRY, MAX_RETRY, SAFETY, DEGRADED = 1.0, 30.0, 1.5, 2.0
ALPHA, LEAST_SECONDS = 0.2, 1e-3
FAILURES, COOLDOWN = 3, 10.0
RSS_LIMIT = 12_288.0


def work(size: Column) -> Column:
    return F.lit(BASE_COST) + F.lit(PER_CHAR) * size


def load_state(rss_mb: Column, authority_degraded: Column, in_flight: Column, backlog: Column, cache_degraded: Column, max_in_flight: int = MAX_IN_FLIGHT, max_backlog: float = MAX_BACKLOG) -> Column:
    return (
        F.when(rss_mb > RSS_LIMIT, "CRITICAL")
        .when(authority_degraded, "STORAGE_DEGRADED")
        .when((in_flight >= max_in_flight) | (backlog > 0.8 * max_backlog), "OVERLOADED")
        .when(cache_degraded, "CACHE_DEGRADED")
        .otherwise("NORMAL")
    )


def retry_after(outstanding: Column, incoming: Column, service_rate: Column, arrival_rate: Column, latency: Column, authority_degraded: Column) -> Column:
    """Seconds to wait, to a tenth: the backlog at the rate of service, longer under pressure and where storage is down."""
    served = service_rate > 0
    base = F.when(served, (outstanding + incoming) / service_rate).otherwise(F.greatest(latency, F.lit(MIN_RETRY)))
    pressure = F.when(served, F.greatest(F.lit(1.0), arrival_rate / service_rate)).otherwise(1.0)
    least = F.least(MIN_RETRY * F.greatest(F.lit(1.0), pressure / 2), F.lit(MAX_RETRY / 3))
    wait = base * pressure * SAFETY * F.when(authority_degraded, DEGRADED).otherwise(1.0)
    return F.round(F.least(F.greatest(wait, least), F.lit(MAX_RETRY)), 1)


def status_of(size: Column, admitted: Column, wait: Column) -> tuple[Column, Column]:
    """HTTP status and Retry-After header."""
    status = F.when(size > MAX_PAYLOAD, 413).when(admitted, 200).otherwise(429)
    return status, F.when(status == 429, F.ceil(wait))


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


def smoothed_rate(log: DataFrame, by: str, ts: str, amount: str, alpha: float = ALPHA) -> DataFrame:
    """(by, n, rate): amounts per second, exponentially smoothed; the first event only sets the clock."""
    timed = log.withColumn(ts, F.unix_micros(F.col(ts).cast("timestamp"))).withColumn(amount, F.col(amount).cast("double"))

    def step(state: list, event: tuple) -> tuple:
        now, value = event
        if state[2] is not None:
            seconds = max((now - state[2]) / 1e6, LEAST_SECONDS)
            state[1] = alpha * (value / seconds) + (1 - alpha) * state[1]
        state[0] += 1
        state[2] = now
        return state[0], state[1]

    schema = _fields(n=T.IntegerType(), rate=T.DoubleType())
    return folded(timed, by, [ts, amount], [ts, amount], lambda: [0, 0.0, None], step, schema, last_only=True)


def admission_gate(log: DataFrame, by: str = "worker", max_in_flight: int = MAX_IN_FLIGHT, max_backlog: float = MAX_BACKLOG, rss_limit: float = RSS_LIMIT) -> DataFrame:
    """(by, seq, event, admitted, reason) for a log of acquire and release events (seq, event, request, payload_size and, if known,
    rss_mb): a request is turned away under critical memory, then at the limit of requests, then at that of work; a release counts if its
    request was admitted."""
    if "rss_mb" not in log.columns:
        log = log.withColumn("rss_mb", F.lit(0.0))

    def step(state: list, event: tuple) -> tuple:
        seq, kind, request, size, rss = event
        open_, backlog = state
        if kind != "acquire":
            state[1] = backlog - open_.pop(request, 0.0)
            return seq, kind, None, None
        cost = BASE_COST + PER_CHAR * size
        reason = None
        if rss is not None and rss > rss_limit:
            reason = "critical_pressure"
        elif len(open_) >= max_in_flight:
            reason = "in_flight_limit"
        elif backlog + cost > max_backlog:
            reason = "backlog_limit"
        if reason is None:
            open_[request] = cost
            state[1] = backlog + cost
        return seq, kind, reason is None, reason

    schema = _fields(seq=T.LongType(), event=T.StringType(), admitted=T.BooleanType(), reason=T.StringType())
    return folded(log, by, ["seq"], ["seq", "event", "request", "payload_size", "rss_mb"], lambda: [{}, 0.0], step, schema)


def breaker_states(log: DataFrame, by: str = "backend", failures: int = FAILURES, cooldown: float = COOLDOWN) -> DataFrame:
    """(by, seq, state) before each outcome of a log (seq, ts, ok): open after so many failures in a row, half open after the cooldown, open again after a failed probe."""
    timed = log.withColumn("ts", F.unix_micros("ts"))

    def step(state: list, event: tuple) -> tuple:
        seq, now, ok = event
        failed, since = state
        said = "closed" if failed < failures else "half_open" if now - since >= cooldown * 1e6 else "open"
        if said != "open":
            state[0] = 0 if ok else failed + 1
            state[1] = now if state[0] >= failures else since if not ok else None
        return seq, said

    return folded(timed, by, ["seq"], ["seq", "ts", "ok"], lambda: [0, None], step, _fields(seq=T.LongType(), state=T.StringType()))


#: Upper bounds of a Retry-After histogram's buckets. Fixed values.
RETRY_BUCKETS = (1, 2, 5, 10, 15, 30)


def request_metrics(answers: DataFrame, by: tuple[str, ...] = ("direction", "outcome")) -> DataFrame:
    """Requests, errors, rejects, latency and waits by direction and outcome, from answers (direction, status, seconds, retry_after, tokens)."""
    outcome = F.when(F.col("status") < 400, "ok").when(F.col("status") == 429, "rejected").otherwise("error")
    waits = [F.count_if(F.col("retry_after") <= b).alias(f"wait_le_{b}") for b in RETRY_BUCKETS]
    return answers.withColumn("outcome", outcome).groupBy(*by).agg(
        F.count("*").alias("requests"), F.count_if(F.col("outcome") == "error").alias("errors"), F.count_if(F.col("status") == 429).alias("rejects"),
        F.sum("tokens").alias("tokens"), F.sum("seconds").alias("seconds"), F.max("seconds").alias("slowest"), *waits,
    )


def gauges(decisions: DataFrame, by: str = "worker") -> DataFrame:
    """(by, in_flight, rejected) after a log's last event, from :func:`admission_gate` joined with nothing else: admitted requests less releases of them."""
    return decisions.groupBy(by).agg(F.count_if(F.col("admitted")).alias("admitted"), F.count_if(F.col("reason").isNotNull()).alias("rejected"), F.count_if(F.col("event") != "acquire").alias("releases"))


def health(load: DataFrame, breakers: DataFrame) -> DataFrame:
    """One row of status: the worst load state of the workers (worker, state) and the circuits of the backends (backend, state): storage is ok
    if all are closed, degraded if one is not, and not configured without any."""
    rank = F.array(*[F.lit(x) for x in ("NORMAL", "CACHE_DEGRADED", "OVERLOADED", "STORAGE_DEGRADED", "CRITICAL")])
    worst = load.agg(F.element_at(rank, F.max(F.array_position(rank, F.col("state"))).cast("int")).alias("load_state"))
    circuits = breakers.agg(F.count("*").alias("backends"), F.count_if(F.col("state") != "closed").alias("not_closed"))
    storage = F.when(F.col("backends") == 0, "not-configured").when(F.col("not_closed") == 0, "ok").otherwise("degraded")
    one = F.lit(1)
    both = worst.withColumn("_one", one).join(circuits.withColumn("_one", one), "_one")
    return both.select(F.lit("ok").alias("status"), storage.alias("storage"), F.coalesce("load_state", F.lit("NORMAL")).alias("load_state"), "backends", "not_closed")


def service_metrics(answers: DataFrame, by: list[str]) -> DataFrame:
    """Requests, tokens, detections and masks by the given columns."""
    return answers.groupBy(*by).agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"), F.sum("n_detected").alias("detected"), F.sum("n_masked").alias("masked"))
