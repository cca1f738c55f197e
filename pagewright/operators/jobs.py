"""Jobs and operations: states, leases, claims, metrics, drift, rate limits, budgets, benchmarks, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T, Window as W

from ..functions.rx import SPACES
from .crawl import shared_checkpoints

# States of a job; all but the first two are final.
STATUSES = ["queued", "running", "succeeded", "failed", "timed_out", "canceled", "interrupted", "worker_lost"]
TERMINAL = STATUSES[2:]
LONGEST_MESSAGE = 1000
DRIFT_WINDOW, DRIFT_RATIO = 50, 0.95


def latest_state(events: DataFrame) -> DataFrame:
    """events (job_id, event_id, status, at) -> each job's last state."""
    last = F.struct("at", "event_id")
    return events.groupBy("job_id").agg(F.max_by("status", last).alias("status"), F.max("at").alias("updated_at"), F.count("*").alias("events"))


def by_status(jobs: DataFrame) -> DataFrame:
    """Count of each status, zero for those without a job."""
    known = jobs.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return known.join(jobs.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def claim(jobs: DataFrame, now: Column, worker: str, size: int, lease_seconds: int) -> tuple[DataFrame, DataFrame]:
    """(jobs that are dead, jobs that the worker claims): running jobs past their lease die on their last attempt, others and
    queued ones are claimed by priority and age."""
    expired = (F.col("status") == "running") & (F.col("lease_expires_at") < now)
    dead = jobs.where(expired & (F.col("attempts") >= F.col("max_attempts"))).withColumns({"status": F.lit("failed"), "worker_id": F.lit(""), "lease_expires_at": F.lit(None).cast("timestamp")})
    free = jobs.where((F.col("status") == "queued") | expired & (F.col("attempts") < F.col("max_attempts")))
    picked = free.orderBy("priority", "created_at", "job_id").limit(size)
    lease = now + F.make_dt_interval(secs=F.lit(lease_seconds).cast("decimal(18,6)"))
    return dead, picked.withColumns({"status": F.lit("running"), "worker_id": F.lit(worker), "attempts": F.col("attempts") + 1, "lease_expires_at": lease})


def recovered(jobs: DataFrame, now: Column) -> DataFrame:
    """Running jobs whose lease ran out go back to the queue while they have attempts left, else end as worker_lost."""
    lost = F.coalesce((F.col("status") == "running") & (F.col("lease_expires_at") < now), F.lit(False))
    again = F.col("attempts") < F.col("max_attempts")
    return jobs.withColumns({"status": F.when(lost & again, "queued").when(lost, "worker_lost").otherwise(F.col("status")), "error": F.when(lost & ~again, "worker_lost")})


def failed(jobs: DataFrame, message: Column) -> DataFrame:
    """Back to the queue while attempts are left, else failed; messages are cut at 1000 characters."""
    return jobs.withColumns({"status": F.when(F.col("attempts") < F.col("max_attempts"), "queued").otherwise("failed"), "error": F.substring(message, 1, LONGEST_MESSAGE)})


def with_status(jobs: DataFrame, status: str = "") -> DataFrame:
    """Jobs of a state; all of them for an empty one. An unknown state is an error."""
    if status and status not in STATUSES:
        raise ValueError(f"unknown status {status!r}; there are: {', '.join(STATUSES)}")
    return jobs.where(F.col("status") == status) if status else jobs


def _changed(jobs: DataFrame, wanted: DataFrame, guard: Column, changes: dict) -> DataFrame:
    """jobs with changes to those rows that are wanted (job_id, and what changes name) and meet the guard."""
    both = jobs.alias("j").join(wanted.withColumn("_wanted", F.lit(True)).alias("w"), F.col("j.job_id") == F.col("w.job_id"), "left")
    hit = F.coalesce(F.col("w._wanted") & guard, F.lit(False))
    return both.select(*[(F.when(hit, changes[c]).otherwise(F.col(f"j.{c}")) if c in changes else F.col(f"j.{c}")).alias(c) for c in jobs.columns])


def _lease(now: Column, seconds: int) -> Column:
    return now + F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))


def heartbeat(jobs: DataFrame, beats: DataFrame, now: Column, lease_seconds: int = 45) -> DataFrame:
    """beats (job_id, worker_id): a running job of that worker gets a new lease; others stay as they are."""
    own = (F.col("j.status") == "running") & (F.col("j.worker_id") == F.col("w.worker_id"))
    return _changed(jobs, beats, own, {"lease_expires_at": _lease(now, lease_seconds), "updated_at": now})


def acknowledged(jobs: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """done (job_id, worker_id): a running job of that worker has succeeded."""
    own = (F.col("j.status") == "running") & (F.col("j.worker_id") == F.col("w.worker_id"))
    return _changed(jobs, done, own, {"status": F.lit("succeeded"), "worker_id": F.lit(""), "lease_expires_at": F.lit(None), "error": F.lit(""), "updated_at": now})


def finished(jobs: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """outcomes (job_id, status, error): running jobs end so; a job that isn't running stays. Only final states may be asked for."""
    checked = outcomes.withColumn("status", F.when(F.col("status").isin(TERMINAL), F.col("status")).otherwise(F.raise_error(F.lit("finish requires a terminal status")).cast("string")))
    changes = {"status": F.col("w.status"), "error": F.substring(F.col("w.error"), 1, LONGEST_MESSAGE), "worker_id": F.lit(""), "lease_expires_at": F.lit(None), "updated_at": now}
    return _changed(jobs, checked, F.col("j.status") == "running", changes)


def canceled(jobs: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """wanted (job_id): a queued job is canceled at once, a running one is marked for its worker to see."""
    live = F.col("j.status").isin("queued", "running")
    return _changed(jobs, wanted, live, {"status": F.when(F.col("j.status") == "queued", "canceled").otherwise(F.col("j.status")), "cancel_requested_at": now, "updated_at": now})


def retried(jobs: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """wanted (job_id): an ended job goes back to the queue as if it had never run."""
    changes = {"status": F.lit("queued"), "attempts": F.lit(0), "worker_id": F.lit(""), "lease_expires_at": F.lit(None), "cancel_requested_at": F.lit(None), "error": F.lit(""), "updated_at": now}
    return _changed(jobs, wanted, F.col("j.status").isin(TERMINAL), changes)


def events_since(events: DataFrame, last_id: Column | int, job_id: str | None = None) -> DataFrame:
    """Events (event_id, job_id, ...) after an id, in order: of one job, or of all."""
    after = events.where(F.col("event_id") > last_id)
    return (after if job_id is None else after.where(F.col("job_id") == job_id)).orderBy("event_id")


IDLE_TICKS = 3


def completion(ticks: DataFrame) -> DataFrame:
    """ticks (run_id, tick, seeds, seeds_done, found, places_done) -> run_id, tick and reason of each run's end; null while it goes on.

    done: all seeds and all places that were found; idle: something was done once, and nothing more in three ticks.
    """
    w = W.partitionBy("run_id").orderBy("tick")
    before = [F.lag(c).over(w) for c in ("seeds_done", "places_done")]
    moved = F.coalesce((F.col("seeds_done") != before[0]) | (F.col("places_done") != before[1]), F.lit(True))
    since = ticks.withColumn("_moved", F.max(F.when(moved, F.col("tick"))).over(w))
    idle = (F.count(F.lit(1)).over(W.partitionBy("run_id", "_moved").orderBy("tick")) - 1 >= IDLE_TICKS) & ((F.col("seeds_done") > 0) | (F.col("places_done") > 0))
    done = (F.col("seeds_done") >= F.col("seeds")) & (F.col("places_done") >= F.col("found"))
    marked = since.withColumn("_idle", idle).withColumn("_why", F.when(done, "done").when(F.col("_idle"), "idle"))
    return marked.groupBy("run_id").agg(F.min(F.when(F.col("_why").isNotNull(), F.struct("tick", "_why"))).alias("e")).select("run_id", F.col("e.tick").alias("tick"), F.col("e._why").alias("reason"))


def until_quiet(results: DataFrame, idle_ms: int, timeout_ms: int, limit: int) -> DataFrame:
    """results (run_id, at_ms since the run's begin, item): those before the run is cut off, with the reason on its last one.

    A run ends at its limit of results, after `idle_ms` without one, or at its timeout.
    """
    w = W.partitionBy("run_id").orderBy("at_ms", "item")
    placed = results.withColumn("n", F.row_number().over(w)).withColumn("_gap", F.col("at_ms") - F.lag("at_ms").over(w))
    broken = F.max(F.coalesce(F.col("_gap") > idle_ms, F.lit(False))).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    kept = placed.withColumn("_broken", broken).where((F.col("n") <= limit) & (F.col("at_ms") <= timeout_ms) & ~F.col("_broken"))
    last = F.max("n").over(W.partitionBy("run_id"))
    why = F.when(F.col("n") == limit, "limit").when(F.col("at_ms") + idle_ms > timeout_ms, "timeout").otherwise("idle")
    return kept.withColumn("reason", F.when(F.col("n") == last, why)).drop("_gap", "_broken")


def coalesced(requests: DataFrame, key: list[str]) -> DataFrame:
    """One request for all that ask for the same at once, and how many there are."""
    return requests.groupBy(*key).agg(F.count("*").alias("waiting"))


def outcome(deadline: Column, canceled: Column, rows: Column, cancel_requested: Column, error: Column) -> Column:
    return (
        F.when(deadline, "timed_out").when(canceled & (rows > 0), "succeeded").when(canceled & cancel_requested, "canceled").when(canceled, "interrupted").when(error.isNotNull(), "failed").otherwise("succeeded")
    )


def purged(jobs: DataFrame, before: Column) -> DataFrame:
    """What stays after terminal jobs last touched before a time are gone."""
    return jobs.where(~(F.col("status").isin(TERMINAL) & (F.col("updated_at") < before)))


# What a job's owner is told, and when.
ADVICE = {
    "empty": "Revise termos, localização e profundidade antes de executar novamente.",
    "partial": "Há resultados parciais; aumente o tempo máximo ou reduza o escopo.",
    "email": "Revise os e-mails enriquecidos antes de qualquer contato e respeite a legislação aplicável.",
    "filled": "Crie uma exportação filtrada para trabalhar apenas com os contatos relevantes.",
}


def recommendations(status: Column, rows: Column, partial: Column, email: Column) -> Column:
    """Advice for a job by its state, its results, whether they are partial and whether addresses were looked up."""
    when = {"empty": rows == 0, "partial": partial, "email": email, "filled": (status == "succeeded") & (rows > 0)}
    return F.array_compact(F.array(*[F.when(cond, ADVICE[k]) for k, cond in when.items()]))


def metrics(events: DataFrame) -> DataFrame:
    return events.groupBy("metric").agg(F.sum("value").alias("total"))


def service_snapshot(requests: DataFrame) -> DataFrame:
    return requests.agg(F.count("*").alias("requests"), F.count_if(F.col("failed")).alias("failures"), F.coalesce(F.try_divide(F.sum("ms"), F.count("*")), F.lit(0.0)).alias("average_ms"))


def drift(records: DataFrame, order: list, fields: list[str], window: int = DRIFT_WINDOW, ratio: float = DRIFT_RATIO, partition: list[str] = ()) -> DataFrame:
    """Share of missing values in each full run of `window` records, and whether it warns. Runs count within a partition.

    Records are dealt out by ranges of the order and numbered in each; a record's number is its place there plus the
    records of earlier ranges, so no task holds a whole partition. Ranges are checkpointed: worked out twice they may differ.
    """
    shared_checkpoints(records.sparkSession)
    within = [*partition, "_range"]
    dealt = records.repartitionByRange(*partition, *order).withColumn("_range", F.spark_partition_id()).checkpoint()
    w = W.partitionBy(*partition).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = dealt.groupBy(*within).agg(F.count("*").alias("_own")).withColumn("_before", F.coalesce(F.sum("_own").over(w), F.lit(0))).drop("_own")
    place = F.row_number().over(W.partitionBy(*within).orderBy(*order))
    own = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in within]
    # Without a partition there is one row a range to broadcast.
    numbered = dealt.withColumn("_place", place).alias("l").join((before if partition else F.broadcast(before)).alias("r"), own)
    runs = numbered.select("l.*", "r._before").withColumn("run", F.floor((F.col("_before") + F.col("_place") - 1) / window)).drop("_range", "_before", "_place").groupBy(*partition, "run")
    missing = [F.avg((F.coalesce(F.col(f).cast("string"), F.lit("")) == "").cast("double")).alias(f"{f}_missing") for f in fields]
    out = runs.agg(F.count("*").alias("n"), *missing).where(F.col("n") == window)
    warn = F.lit(False)
    for f in fields:
        warn = warn | (F.col(f"{f}_missing") > ratio)
    return out.withColumn("warns", warn)


def within_budget(items: DataFrame, cost: str, cap: int, order: list[str], partition: str) -> DataFrame:
    """Takes items in order while they fit: one that doesn't is refused and uses nothing up, later ones may still fit."""
    kept = T.StructType([*items.schema.fields, T.StructField("taken", T.BooleanType())])

    def run(pdf):
        pdf = pdf.sort_values(order, kind="stable")
        used, taken = 0, []
        for n in pdf[cost]:
            ok = used + n <= cap
            used += n if ok else 0
            taken.append(ok)
        return pdf.assign(taken=taken)

    return items.groupBy(partition).applyInPandas(run, kept)


def throttled(requests: DataFrame, spacing_ms: int = 300) -> DataFrame:
    """requests (domain, request_id, at_ms) -> when each starts, at least `spacing_ms` after the one before on its domain.

    start_i = max(at_i, start_(i-1) + s) is a running maximum: max over j <= i of at_j + (i - j) s.
    """
    w = W.partitionBy("domain").orderBy("at_ms", "request_id")
    n = F.row_number().over(w)
    ahead = F.max(F.col("at_ms") - F.col("_n") * spacing_ms).over(w.rowsBetween(W.unboundedPreceding, 0))
    return requests.withColumn("_n", n).withColumn("start_ms", ahead + F.col("_n") * spacing_ms).drop("_n")


def adaptive_concurrency(observations: DataFrame, low: int, high: int, fast_ms: int = 5000, slow_ms: int = 15000) -> DataFrame:
    """observations (worker, at_s, success, latency_ms) -> limit after each: one up when fast, one down when slow or failed.

    Of observations less than a second after the last one that counted, none counts, whether that one moved the limit or not.
    """
    kind = T.StructType([*observations.schema.fields, T.StructField("limit", T.IntegerType())])

    def run(pdf):
        pdf = pdf.sort_values("at_s", kind="stable")
        limit, last, out = low, None, []
        for at, good, ms in zip(pdf["at_s"], pdf["success"], pdf["latency_ms"]):
            if last is None or at - last >= 1:
                step = -1 if not good or ms > slow_ms else 1 if ms < fast_ms else 0
                limit, last = min(high, max(low, limit + step)), at
            out.append(limit)
        return pdf.assign(limit=out)

    return observations.groupBy("worker").applyInPandas(run, kind)


def backoff_schedule(first_ms: int, factor: int, retries: int, spark) -> DataFrame:
    return spark.range(1, retries + 1).select(F.col("id").cast("int").alias("attempt"), (F.lit(first_ms) * F.pow(F.lit(factor), F.col("id") - 1)).cast("long").alias("delay_ms"))


VISIBLE = 100  #: characters without white space that a page of a benchmark must have


def bench_worked(status: Column, markdown: Column) -> Column:
    """Whether a benchmark's request worked: status 200 and enough visible characters."""
    return F.coalesce((status == 200) & (F.length(F.regexp_replace(markdown, f"[{SPACES}]+", "")) >= VISIBLE), F.lit(False))


def bench_sites(runs: DataFrame, sites: DataFrame) -> DataFrame:
    """Runs with their site's columns, by site_id; runs of unknown sites go."""
    return runs.join(sites, "site_id")


def bench_summary(rows: DataFrame) -> DataFrame:
    """Per tool, and per tool and country: count, share that worked, P50 and P95 by nearest rank, median tokens, emails a site."""
    view = rows.withColumns({"ok_ms": F.when(F.col("ok"), F.col("ms")), "ok_tokens": F.when(F.col("ok"), F.col("tokens"))})
    name = "pagewright_bench_rows"
    view.createOrReplaceTempView(name)
    return rows.sparkSession.sql(f"""
        SELECT tool, CASE WHEN grouping(country) = 1 THEN 'all' ELSE country END AS scope, count(*) AS n,
          round(100.0 * count_if(ok) / count(*), 4) AS ok_percent,
          percentile_disc(0.5) WITHIN GROUP (ORDER BY ok_ms) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY ok_ms) AS p95,
          percentile_disc(0.5) WITHIN GROUP (ORDER BY ok_tokens) AS median_tokens, sum(emails) / count(*) AS emails_per_site, count_if(emails > 0) AS sites_with_email
        FROM {name} GROUP BY GROUPING SETS ((tool), (tool, country))""")


BENCH_HEADER = "| Tool | Group | Sites | Success | P50 s | P95 s | Tokens/page (median) | Emails/site | Sites with an email |"


def bench_table(summary: DataFrame) -> DataFrame:
    """The summary as lines of a Markdown table (place, line): the header, then each tool, `all` before its countries."""
    shown = lambda c, f, by=1: F.when(c.isNotNull(), F.format_string(f, c.cast("double") / by)).otherwise("–")
    ok = F.round(F.col("ok_percent") * F.col("n") / 100).cast("long").cast("string")
    cells = ["tool", "scope", F.col("n").cast("string"), F.concat(ok, F.lit(" ("), shown(F.col("ok_percent"), "%.0f"), F.lit("%)")), shown(F.col("p50"), "%.2f", 1000), shown(F.col("p95"), "%.2f", 1000), shown(F.col("median_tokens"), "%.0f"), shown(F.col("emails_per_site"), "%.2f"), F.col("sites_with_email").cast("string")]
    lines = summary.select(F.struct("tool", (F.col("scope") != "all").alias("country"), "scope").alias("place"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    head = lines.sparkSession.createDataFrame([(0, BENCH_HEADER), (1, "|" + "---|" * 9)], "place int, line string")
    body = lines.select((F.row_number().over(W.orderBy("place")) + 1).alias("place"), "line")  # a summary is a few rows
    return head.unionByName(body)


#: Limits of a job's parameters: name -> (default, least, most).
JOB_LIMITS = {"depth": (10, 1, 100), "zoom": (15, 1, 21), "radius": (10_000, 0, 500_000), "max_time_s": (1800, 60, 86_400)}
MOST_KEYWORDS, LONGEST_KEYWORD, LONGEST_LOCATION = 100, 300, 240


def validated(job: dict) -> dict:
    """A job's parameters with defaults, keywords trimmed and distinct but for case; a ValueError names what is wrong."""
    out = dict(job)
    keywords: dict[str, str] = {}
    for k in map(str.strip, job.get("keywords", [])):
        if len(k) > LONGEST_KEYWORD:
            raise ValueError(f"keyword exceeds {LONGEST_KEYWORD} characters")
        if k:
            keywords.setdefault(k.lower(), k)
    if not keywords:
        raise ValueError("missing keywords")
    if len(keywords) > MOST_KEYWORDS:
        raise ValueError(f"too many keywords; maximum is {MOST_KEYWORDS}")
    out["keywords"] = list(keywords.values())
    out["location"] = (job.get("location") or "").strip()
    if len(out["location"]) > LONGEST_LOCATION:
        raise ValueError(f"location exceeds {LONGEST_LOCATION} characters")
    out["lang"] = job.get("lang") or "en"
    if not 2 <= len(out["lang"]) <= 12:
        raise ValueError("invalid language code")
    for name, (default, least, most) in JOB_LIMITS.items():
        out[name] = job.get(name) or default
        if not least <= out[name] <= most:
            raise ValueError(f"{name} must be between {least} and {most}")
    if job.get("fast_mode") and not all(str(job.get(k) or "").strip() for k in ("lat", "lon")):
        raise ValueError("latitude and longitude are required in fast mode")
    return out


def checked_fields(body: dict, honoured: set[str], ignored: set[str] = frozenset()) -> dict:
    """The fields that are honoured; any other than those and the ignored ones is an error that names it."""
    for name in body:
        if name not in honoured and name not in ignored:
            raise ValueError(f"unknown field {name!r}")
    return {k: v for k, v in body.items() if k in honoured}


def nearest_rank(column: str, p: float) -> Column:
    """The nearest-rank percentile; null for no rows."""
    return F.expr(f"percentile_disc({p}) within group (order by {column})")


def payload_envelope(job: Column) -> Column:
    """A job as JSON with a checksum."""
    data = F.to_json(job)
    return F.struct(F.lit(1).alias("version"), F.lit("job").alias("type"), F.lit("json").alias("encoding"), F.sha2(data, 256).alias("sha256"), data.alias("data"))


def payload_intact(envelope: Column) -> Column:
    return F.sha2(envelope["data"], 256) == envelope["sha256"]
