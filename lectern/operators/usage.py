"""Question-log analytics and the alerts drawn from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .answers import NOT_FOUND
from .history import local_time
from .scan import exact_median

# Alert thresholds.
INVALID_MAX = 0.1
REFUSED_MAX = 0.25
MIN_QUESTIONS = 10
BACKUP_OLD_DAYS = 2
SYNC_GRACE_DAYS = 2
# The actions a sync run counts, and the tabs of the overview.
COUNTED = ["downloaded", "saved_page", "already_had", "would_download", "would_save_page", "failed"]
TABS = ["overview", "library", "quality", "settings"]


def _refused() -> Column:
    return F.count_if(F.coalesce(F.col("answer") == NOT_FOUND, F.lit(False)))


def since(log: DataFrame, days: int, now: str) -> DataFrame:
    """Rows of the last ``days`` days (0 = all); a plain range filter on ``ts``, so it reaches the scan."""
    if not days:
        return log
    return log.filter(F.col("ts") >= F.expr(f"timestamp_ntz'{now}' - INTERVAL {int(days)} DAY"))


def log_summary(log: DataFrame, days: int, now: str) -> DataFrame:
    """Questions, refusals, invalid citations, failures, median and maximum latency."""
    rows = since(log, days, now)
    one = rows.agg(
        F.count("*").alias("questions"), _refused().alias("refused"),
        F.count_if(F.coalesce(F.col("citation_valid") == F.lit(False), F.lit(False))).alias("invalid"),
        F.count_if(F.col("answer").isNull()).alias("failed"),
        F.max("latency_ms").cast("bigint").alias("max_ms"))
    median = exact_median(rows, [], "latency_ms", "_m")
    joined = one.join(F.broadcast(median), F.lit(True), "left")  # one row each
    return joined.select("questions", "refused", "invalid", "failed", F.col("_m").cast("bigint").alias("median_ms"), "max_ms")


def log_by_module(log: DataFrame, days: int, now: str) -> DataFrame:
    g = since(log, days, now).groupBy("course").agg(F.count("*").alias("questions"), _refused().alias("refused"))
    return g.orderBy(F.desc("questions"), F.asc_nulls_last("course"))


def log_by_day(log: DataFrame, days: int, now: str, tz: str = "UTC") -> DataFrame:
    day = F.to_date(local_time(F.col("ts"), tz)).alias("day")
    rows = since(log, days, now).withColumn("day", day)
    counted = rows.groupBy("day").agg(F.count("*").alias("questions"))
    median = exact_median(rows, ["day"], "latency_ms", "_m")
    return (counted.join(median.withColumnRenamed("day", "_day"), F.col("day").eqNullSafe(F.col("_day")), "left")
            .select("day", "questions", F.col("_m").cast("bigint").alias("median_ms")).orderBy("day"))


def fill_days(daily: DataFrame, today: str, days: int = 0) -> DataFrame:
    """Every calendar day up to ``today`` from the window's start (or the first day with data), zero where empty."""
    first = F.expr(f"date'{today}' - {int(days) - 1}") if days > 0 else F.min("day")
    axis = daily.agg(F.explode(F.sequence(first, F.expr(f"date'{today}'"))).alias("day"))
    return axis.join(daily, "day", "left").select(
        "day", F.coalesce("questions", F.lit(0)).alias("questions"), "median_ms")


def problems(log: DataFrame, kind: str, days: int, now: str, limit: int) -> DataFrame:
    """The newest refused or invalid questions, or the slowest ones."""
    rows = since(log, days, now)
    if kind == "refused":
        rows, order = rows.filter(F.col("answer") == NOT_FOUND), [F.desc("id")]
    elif kind == "invalid":
        rows, order = rows.filter(F.col("citation_valid") == F.lit(False)), [F.desc("id")]
    elif kind == "slow":
        rows, order = rows.filter(F.col("latency_ms").isNotNull()), [F.desc("latency_ms"), F.desc("id")]
    else:
        raise ValueError(f"unknown kind {kind!r}")
    return rows.select("id", "ts", "question", "course", "latency_ms").orderBy(*order).limit(limit)


def latest_questions(log: DataFrame, limit: int) -> DataFrame:
    """The most recent distinct (question, course) pairs with the id of their last asking."""
    return (log.groupBy("question", "course").agg(F.max("id").alias("id"))
            .orderBy(F.desc("id")).limit(limit))


def compare_modes(questions: DataFrame, dense: DataFrame, hybrid: DataFrame) -> DataFrame:
    """What changes between two retrieval modes: sources used by only one, and flipped answer/refuse verdicts.

    ``dense`` and ``hybrid`` are ``retrieve`` outputs for the same questions.
    """

    def used(hits: DataFrame, name: str) -> DataFrame:
        return hits.filter("used").select("question_id", "chunk_id", F.lit(True).alias(name))

    both = used(dense, "d").join(used(hybrid, "h"), ["question_id", "chunk_id"], "full_outer")
    g = both.groupBy("question_id").agg(
        F.count("d").alias("n_dense"), F.count("h").alias("n_hybrid"),
        F.sort_array(F.collect_list(F.when(F.col("h").isNull(), F.col("chunk_id")))).alias("only_dense"),
        F.sort_array(F.collect_list(F.when(F.col("d").isNull(), F.col("chunk_id")))).alias("only_hybrid"))
    j = questions.join(g, "question_id", "left")
    n_d, n_h = F.coalesce("n_dense", F.lit(0)), F.coalesce("n_hybrid", F.lit(0))
    empty = F.array().cast("array<bigint>")
    j = j.withColumn("only_dense", F.coalesce("only_dense", empty)).withColumn(
        "only_hybrid", F.coalesce("only_hybrid", empty))
    verdict = [F.when(n > 0, "answer").otherwise("refuse").alias(c)
               for n, c in ((n_d, "verdict_dense"), (n_h, "verdict_hybrid"))]
    return j.select(*questions.columns, *verdict, "only_dense", "only_hybrid",
                    ((F.size("only_dense") > 0) | (F.size("only_hybrid") > 0)).alias("changed"),
                    ((n_d > 0) != (n_h > 0)).alias("flipped"))


def compare_summary(compared: DataFrame) -> DataFrame:
    return compared.agg(F.count("*").alias("questions"), F.count_if("changed").alias("changed"),
                        F.count_if("flipped").alias("flipped"))


def recent_latency(log: DataFrame, n: int = 20) -> DataFrame:
    """Count, median, maximum and time of the last ``n`` answered questions."""
    last = log.filter(F.col("latency_ms").isNotNull()).orderBy(F.desc("id")).limit(n)
    return last.agg(F.count("*").alias("count"), F.percentile("latency_ms", 0.5).cast("bigint").alias("median_ms"),
                    F.max("latency_ms").alias("max_ms"), F.max_by("ts", "id").alias("last_at"))


def index_counts(docs: DataFrame, chunks: DataFrame, excluded: DataFrame) -> DataFrame:
    """Documents, chunks, chunks read from images, excluded paths."""
    c = chunks.agg(F.count("*").alias("chunks"), F.count_if(F.coalesce("ocr", F.lit(False))).alias("ocr_chunks"))
    return c.select(docs.agg(F.count("*")).scalar().alias("documents"), "chunks",
                    excluded.agg(F.count("*")).scalar().alias("excluded"), "ocr_chunks")


def attention(inputs: DataFrame, now: str, key: str = "tenant") -> DataFrame:
    """Alert rows (key, id, severity, tab), worst first. One input row per library, one pass over it.

    A source column ``<name>_state`` is ``ok``, ``failed`` (could not be checked) or NULL (not loaded, no alerts).
    """
    t = F.to_timestamp_ntz(F.lit(now))

    def older(ts: Column, days: Column) -> Column:
        late = F.unix_micros(t.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))
        return ts.isNull() | (late > days * 86_400_000_000)

    def loaded(name: str) -> Column:
        return F.coalesce(F.col(f"{name}_state") == "ok", F.lit(False))

    enough = loaded("insights") & (F.col("questions") >= MIN_QUESTIONS)
    stopped = F.coalesce(F.col("last_sync_state").isin("failed", "login_required"), F.lit(False))
    login = F.coalesce("login_needed", F.lit(False))
    rules = [
        (F.coalesce(F.col("status_state") == "failed", F.lit(False)), "failed:status", "warn", "overview"),
        (F.coalesce(F.col("library_state") == "failed", F.lit(False)), "failed:library", "warn", "library"),
        (F.coalesce(F.col("sync_state") == "failed", F.lit(False)), "failed:sync", "warn", "library"),
        (F.coalesce(F.col("insights_state") == "failed", F.lit(False)), "failed:insights", "warn", "quality"),
        (loaded("status") & ~F.coalesce("services_ok", F.lit(False)), "services", "bad", "overview"),
        (loaded("status") & older(F.col("backup_at"), F.lit(BACKUP_OLD_DAYS)), "backup", "warn", "overview"),
        # the first of the three that holds
        (loaded("sync") & login, "sync-login", "bad", "library"),
        (loaded("sync") & ~login & stopped, "sync-failed", "bad", "library"),
        (loaded("sync") & ~login & ~stopped
         & older(F.col("last_full_sync"), F.col("auto_days") + SYNC_GRACE_DAYS), "sync-old", "warn", "library"),
        (loaded("library") & (F.col("problems") > 0), "unreadable", "warn", "library"),
        (loaded("library") & (F.col("summary_errors") > 0), "summaries", "info", "library"),
        (enough & (F.col("invalid") / F.col("questions") > INVALID_MAX), "invalid", "warn", "quality"),
        (enough & (F.col("refused") / F.col("questions") > REFUSED_MAX), "refused", "warn", "quality"),
    ]
    rank = {"bad": 0, "warn": 1, "info": 2}
    made = [F.when(cond, F.struct(F.lit(rank[sev] * 100 + i).alias("ord"), F.lit(rule).alias("id"),
                                  F.lit(sev).alias("severity"), F.lit(tab).alias("tab")))
            for i, (cond, rule, sev, tab) in enumerate(rules)]
    items = F.filter(F.array(*made), lambda x: x.isNotNull())
    return inputs.select(key, F.inline(items)).orderBy(key, "ord")


def badge_counts(items: DataFrame, keys: DataFrame, key: str = "tenant") -> DataFrame:
    """Alerts per tab (info left out), zero for quiet tabs. ``keys`` lists the libraries."""
    axis = keys.select(key, F.explode(F.array(*[F.lit(x) for x in TABS])).alias("tab"))
    n = items.filter("severity <> 'info'").groupBy(key, "tab").agg(F.count("*").alias("n"))
    return axis.join(n, [key, "tab"], "left").select(key, "tab", F.coalesce("n", F.lit(0)).alias("n"))


def fold_events(events: DataFrame, key: str = "job", order: str = "seq") -> DataFrame:
    """Final state of each sync run from its event rows: counts per action, bytes, last error, state.

    State comes from the ``exit`` event: cancelled, else ok (0), login_required (3) or failed.
    """
    is_file = F.col("type") == "file"
    counts = [F.count_if(F.coalesce(is_file & (F.col("action") == a), F.lit(False))).alias(a) for a in COUNTED]

    def last(col: str, kind: str) -> Column:
        return F.max(F.when(F.col("type") == kind, F.struct(order, col)))[col]

    g = events.groupBy(key).agg(*counts, F.coalesce(last("bytes", "done"), F.lit(0)).alias("bytes"),
                                last("message", "error").alias("error"), last("exit_code", "exit").alias("exit_code"),
                                F.coalesce(last("cancelled", "exit"), F.lit(False)).alias("_c"))
    state = (F.when(F.col("_c"), "cancelled").when(F.col("exit_code").isNull(), "running")
             .when(F.col("exit_code") == 0, "ok").when(F.col("exit_code") == 3, "login_required").otherwise("failed"))
    return g.withColumn("state", state).drop("_c")


def last_full(runs: DataFrame) -> DataFrame:
    """When the last complete sync of everything finished."""
    ok = (F.col("mode") == "sync") & F.col("course").isNull() & (F.col("state") == "ok")
    return runs.agg(F.max(F.when(ok, F.col("finished_at"))).alias("last_full"))
