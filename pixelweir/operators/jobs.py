"""The job log as relations: latest states, expiry, restarts, and settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# States, defaults and ranges of a conversion job.
TERMINAL = ("succeeded", "failed")
TTL_SECONDS = 3600
MODES = ("auto", "line_art", "flat_color", "mixed")
DETAILS = {"low": (64, 2, 1.5, 60.0), "medium": (16, 2, 0.8, 60.0), "high": (4, 2, 0.4, 45.0)}
FORMATS = ("svg", "ai", "eps", "preview")
FIELDS = ("mode", "max_colors", "detail_level", "line_mode", "smoothing", "remove_background", "palette_override", "output_formats")


def latest(log: DataFrame) -> DataFrame:
    """The last row of each job by (ts, event_id), with the highest progress so far and its first time."""
    last = log.groupBy("job_id").agg(F.max_by(F.struct("ts", "event_id", "status", "stage"), F.struct("ts", "event_id")).alias("s"), F.min("ts").alias("created"), F.max("progress").alias("progress"), F.count("*").alias("n_updates"))
    return last.select("job_id", "s.status", "s.stage", "created", F.col("s.ts").alias("updated"), "progress", "n_updates")


def expiry(jobs: DataFrame, now: Column, ttl: int = TTL_SECONDS) -> DataFrame:
    """Adds expires: finished jobs from their last update on, others from now on."""
    start = F.when(F.col("status").isin(*TERMINAL), F.col("updated")).otherwise(now)
    return jobs.withColumn("expires", start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(ttl)))


def sweep(jobs: DataFrame, now: Column, ttl: int = TTL_SECONDS) -> DataFrame:
    """Jobs whose time is over."""
    return expiry(jobs, now, ttl).filter(F.col("expires") <= now)


def fail_unfinished(jobs: DataFrame, reason: str) -> DataFrame:
    """After a restart: jobs that aren't finished have failed."""
    open_ = ~F.col("status").isin(*TERMINAL)
    return jobs.withColumn("error", F.when(open_, F.lit(reason))).withColumn("status", F.when(open_, "failed").otherwise(F.col("status")))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both by job, the later update of each; equal times prefer the new row."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    first = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("updated"), F.desc("_new")))
    return both.withColumn("_k", first).filter("_k = 1").drop("_k", "_new")


def status_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("stage").pivot("status", ["queued", "running", "succeeded", "failed"]).count().na.fill(0)


def parse_settings(raw: Column) -> tuple[Column, Column]:
    """(settings struct with defaults, errors): unknown fields and values out of range, the first five by name."""
    schema = "mode string, max_colors int, detail_level string, line_mode string, smoothing int, remove_background boolean, palette_override array<string>, output_formats array<string>"
    s = F.from_json(raw, schema)
    unknown = F.array_except(F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>")), F.array(*map(F.lit, FIELDS)))
    bad = lambda name, test: F.when(F.coalesce(test, F.lit(False)), F.lit(f"{name}: invalid"))
    errors = F.concat(
        F.when(F.json_object_keys(raw).isNull(), F.array(F.lit("settings: not an object"))).otherwise(F.array().cast("array<string>")),
        F.transform(unknown, lambda k: F.concat(k, F.lit(": unknown field"))),
        F.filter(
            F.array(
                bad("mode", ~s["mode"].isin(*MODES)),
                bad("max_colors", ~s["max_colors"].between(2, 64)),
                bad("detail_level", ~s["detail_level"].isin(*DETAILS)),
                bad("smoothing", ~s["smoothing"].between(0, 100)),
                bad("palette_override", ~F.size(s["palette_override"]).between(1, 64) | F.exists(s["palette_override"], lambda h: ~h.rlike(r"^#[0-9a-fA-F]{6}$"))),
                bad("output_formats", F.exists(s["output_formats"], lambda f: ~f.isin(*FORMATS))),
            ),
            lambda e: e.isNotNull(),
        ),
    )
    formats = F.filter(F.array(*map(F.lit, FORMATS)), lambda f: F.array_contains(F.array_union(F.coalesce(s["output_formats"], F.array().cast("array<string>")), F.array(F.lit("svg"))), f))
    settings = F.struct(
        F.coalesce(s["mode"], F.lit("auto")).alias("mode"),
        s["max_colors"].alias("max_colors"),
        F.coalesce(s["detail_level"], F.lit("medium")).alias("detail_level"),
        F.coalesce(s["line_mode"], F.lit("auto")).alias("line_mode"),
        F.coalesce(s["smoothing"], F.lit(50)).alias("smoothing"),
        F.coalesce(s["remove_background"], F.lit(False)).alias("remove_background"),
        F.array_distinct(F.transform(s["palette_override"], F.lower)).alias("palette_override"),
        formats.alias("output_formats"),
    )
    return settings, F.slice(F.array_sort(errors), 1, 5)


def needs_lines(label: Column, line_mode: Column) -> Column:
    return (label == "line_art") | ((label == "mixed") & (line_mode != "off"))


def error_detail(code: Column, message: Column, stage: Column) -> Column:
    return F.struct(F.coalesce(code, F.lit("internal_error")).alias("code"), message.alias("message"), stage.alias("stage"))


#: Milliseconds before the first poll, at most between polls, and the factor from one to the next.
FIRST_MS, MOST_MS, FACTOR = 300, 2000, 1.5


def poll_delay(k: Column) -> Column:
    """The k-th delay (1 is the first): each is the last one times FACTOR, rounded, within bounds. The bounds are met after few steps."""
    delays = [FIRST_MS]
    while delays[-1] < MOST_MS:
        delays.append(min(MOST_MS, max(FIRST_MS, int(delays[-1] * FACTOR + 0.5))))
    return F.get(F.array(*[F.lit(d) for d in delays]), F.least(k.cast("int"), F.lit(len(delays))) - 1)


def is_final(status: Column) -> Column:
    return status.isin("succeeded", "failed")


def delete(log: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the log without the jobs named, (job_id, existed) of each distinct name): a null or unknown name deletes nothing."""
    named = ids.select("job_id").filter("job_id IS NOT NULL").distinct()
    found = log.select("job_id").distinct().withColumn("_e", F.lit(True))
    return log.join(named, "job_id", "left_anti"), named.join(found, "job_id", "left").select("job_id", F.col("_e").isNotNull().alias("existed"))


def cancel_queued(jobs: DataFrame) -> DataFrame:
    """Adds cancelled: jobs that haven't begun can still be taken back; those that run or are finished can't."""
    return jobs.withColumn("cancelled", F.col("status") == "queued")


def new_row(job_id: Column, now: Column, ttl: int = TTL_SECONDS) -> Column:
    """A job as it is written first."""
    return F.struct(job_id.alias("job_id"), F.lit("queued").alias("status"), F.lit("load").alias("stage"), F.lit(0.0).alias("progress"), now.alias("created"), (now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(ttl))).alias("expires"))


#: Numbers of the service's environment, each with its default and least value.
ENVIRONMENT = {"MAX_WORKERS": (2, 1), "JOB_TTL_SECONDS": (TTL_SECONDS, 1), "CLEANUP_INTERVAL_SECONDS": (60, 1), "MAX_UPLOAD_BYTES": (20 * 1024 * 1024, 1)}


def environment_number(name: Column, raw: Column) -> tuple[Column, Column]:
    """(value, error) of an environment setting: blank or null gives the default, and an error leaves no value."""
    pick = lambda k: F.element_at(F.create_map(*[F.lit(x) for n, v in ENVIRONMENT.items() for x in (n, v[k])]), name)
    bare = F.trim(F.coalesce(raw, F.lit("")))
    number = F.when(bare.rlike("^[+-]?[0-9]{1,18}$"), bare).try_cast("long")
    error = F.when(pick(0).isNull(), "unknown setting").when((bare != "") & number.isNull(), "not an integer").when(number < pick(1), F.concat(F.lit("must be at least "), pick(1).cast("string")))
    return F.when(error.isNull(), F.coalesce(number, pick(0).cast("long"))), error
