"""Stateful and stream-like operators: incremental sync, duplicate suppression, cooldowns, state machines, TTL, sessions.

Each has a batch form as windows and joins. Those that run over unbounded input have a Structured Streaming form with the
same results over the same rows; event-time windows over ``events`` are extensions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..operators import chains as C
from ..registry import plain, query
from .processors import Cooldown, processed


def since(rows: DataFrame, marks: DataFrame, key: str, position: str) -> DataFrame:
    """Rows after their key's mark (key, mark); all rows of keys without one (an initial run)."""
    return rows.join(marks, key, "left").where(F.col("mark").isNull() | (F.col(position) > F.col("mark"))).drop("mark")


@query("X1_incremental_sync", "SELECT e.event_id, e.user_id FROM events e LEFT JOIN (SELECT user_id, max(event_id) - 20 AS mark FROM events WHERE user_id % 2 = 0 GROUP BY 1) m USING (user_id) WHERE m.mark IS NULL OR e.event_id > m.mark")
def _(t):
    marks = t.events.where("user_id % 2 = 0").groupBy("user_id").agg((F.max("event_id") - 20).alias("mark"))
    return since(t.events.select("event_id", "user_id"), marks, "user_id", "event_id")


def file_changes(before: DataFrame, now: DataFrame, path: str, digest: str) -> DataFrame:
    """(path, status) of every path in either state: removed, added, changed or same, by digest."""
    a, b = before.select(path, F.col(digest).alias("old_"), F.lit(True).alias("was_")), now.select(path, F.col(digest).alias("new_"), F.lit(True).alias("is_"))
    status = F.when(F.col("is_").isNull(), "removed").when(F.col("was_").isNull(), "added").when(F.col("old_").eqNullSafe(F.col("new_")), "same").otherwise("changed")
    return a.join(b, path, "full").select(path, status.alias("status"))


@query("X2_file_changes", "SELECT COALESCE(a.p, b.p) AS p, CASE WHEN b.p IS NULL THEN 'removed' WHEN a.p IS NULL THEN 'added' WHEN a.h <> b.h THEN 'changed' ELSE 'same' END AS status FROM (SELECT p_partkey AS p, p_size AS h FROM part WHERE p_partkey % 10 <> 0) a FULL OUTER JOIN (SELECT p_partkey AS p, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS h FROM part WHERE p_partkey % 13 <> 0) b ON a.p = b.p")
def _(t):
    p = t.part.select(F.col("p_partkey").alias("p"), F.col("p_size").alias("h"))
    now = p.where("p % 13 <> 0").withColumn("h", F.when(F.col("p") % 7 == 0, F.col("h") + 1).otherwise(F.col("h")))
    return file_changes(p.where("p % 10 <> 0"), now, "p", "h")


def unmarked(rows: DataFrame, marks: DataFrame, *key: str) -> DataFrame:
    """The keys that no mark has yet, each once."""
    return rows.select(*key).distinct().join(marks.select(*key), list(key), "left_anti")


@query("X3_scan_markers", "SELECT DISTINCT o.o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_linenumber >= 6)")
def _(t):
    return unmarked(t.orders, t.lineitem.where("l_linenumber >= 6").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


def first_deliveries(rows: DataFrame, keys: list, order: str) -> DataFrame:
    """Of the rows of each key (names or columns), the first by ``order``."""
    return rows.groupBy(*keys).agg(F.min(order).alias(order))


@query("X4_delivery_dedup", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type, CAST(floor(value) AS BIGINT)")
def _(t):
    return first_deliveries(t.events, ["user_id", "event_type", F.floor("value").alias("delivery")], "event_id").drop("delivery")


def first_of_bursts(rows: DataFrame, key: str, ts: str, tie: str, minutes: int) -> DataFrame:
    """A key's first row, and then each that comes ``minutes`` or more after the one that fired last; what comes between is a repetition."""
    at = rows.withColumn("at_", F.unix_micros(F.col(ts).cast("timestamp")))
    return C.spaced(at, key, "at_", [tie], minutes * 60_000_000).drop("at_")


@query(
    "X5_alarm_cooldown",
    """WITH RECURSIVE fired AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY user_id UNION ALL SELECT f.user_id, (SELECT min(e.ts) FROM events e WHERE e.user_id = f.user_id AND e.ts >= f.ts + INTERVAL 60 MINUTE) FROM fired f WHERE f.ts IS NOT NULL)
    SELECT min(event_id) AS event_id FROM events e JOIN fired f ON e.user_id = f.user_id AND e.ts = f.ts GROUP BY e.user_id, e.ts""",
)
def _(t):
    return first_of_bursts(t.events.select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 60).select("event_id")


def live_hits(rows: DataFrame, key: str, ts: str, now, days: int) -> DataFrame:
    """Hits and the last time of each key among the rows that have not expired at ``now``."""
    return rows.where(F.col(ts) > now - F.expr(f"INTERVAL {days} DAYS")).groupBy(key).agg(F.count("*").alias("hits"), F.max(ts).alias("last_at"))


@query("X6_ttl_hits", "SELECT user_id, count(*) AS hits, max(ts) AS last_at FROM events WHERE ts > TIMESTAMP '2024-01-23 00:00:00' GROUP BY user_id")
def _(t):
    return live_hits(t.events, "user_id", "ts", F.expr("timestamp_ntz'2024-01-30 00:00:00'"), 7)


def progress(rows: DataFrame, key: str, order: list[str], kind: str, score: str) -> DataFrame:
    """The last state of each key's run: events ``start``, ``done`` and ``fail`` set the phase, a score stays until a newer one comes."""
    last = F.struct(*order)
    return rows.groupBy(key).agg(F.max_by(kind, last).alias("phase"), F.max_by(score, F.when(F.col(score).isNotNull(), last)).alias("score"), F.count("*").alias("steps"))


@query("X7_phase_machine", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS phase, arg_max(CASE WHEN value > 50 THEN value END, (ts, event_id)) FILTER (WHERE value > 50) AS score, count(*) AS steps FROM events GROUP BY user_id")
def _(t):
    rows = t.events.withColumn("good", F.when(F.col("value") > 50, F.col("value")))
    return progress(rows, "user_id", ["ts", "event_id"], "event_type", "good")


def stale_runs(rows: DataFrame, key: str, ts: str, before, unfinished) -> DataFrame:
    """Keys whose last sign of life lies before a time and that have a row which says that they never finished."""
    last = rows.groupBy(key).agg(F.max(ts).alias("last_"), F.coalesce(F.bool_or(unfinished), F.lit(False)).alias("open_"))
    return last.where((F.col("last_") < before) & F.col("open_")).select(key)


@query("X8_stale_runs", "SELECT user_id FROM events GROUP BY user_id HAVING max(ts) < TIMESTAMP '2024-01-30 12:00:00' AND count(*) FILTER (WHERE event_type = 'purchase') > 0")
def _(t):
    return stale_runs(t.events, "user_id", "ts", F.expr("timestamp_ntz'2024-01-30 12:00:00'"), F.col("event_type") == "purchase")


def history(rows: DataFrame, key: str, turn: str, last: int) -> DataFrame:
    """The last ``last`` turns of each conversation; Spark cuts to them before the shuffle."""
    return rows.withColumn("rn_", F.row_number().over(W.partitionBy(key).orderBy(F.desc(turn)))).where(F.col("rn_") <= last).drop("rn_")


@query("X9_history_replay", "SELECT conv_id, turn, role FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) x WHERE rn <= 4")
def _(t):
    return history(t.conversations.select("conv_id", "turn", "role"), "conv_id", "turn", 4)


def with_delta(rows: DataFrame, key: str, order: list[str], value) -> DataFrame:
    """Each measurement's difference from the key's measurement before it, null for the first."""
    return rows.withColumn("delta", value - F.lag(value).over(W.partitionBy(key).orderBy(*order)))


@query("X10_probe_history", "SELECT user_id, event_id, CAST(round(value * 100) AS BIGINT) - lag(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS delta FROM events WHERE event_type = 'view'")
def _(t):
    cents = F.round(F.col("value") * 100).cast("long")
    return with_delta(t.events.where("event_type = 'view'"), "user_id", ["ts", "event_id"], cents).select("user_id", "event_id", "delta")


def monthly_use(rows: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """X11: uses of each key by month."""
    return rows.groupBy(*keys, F.date_trunc("month", ts).cast("timestamp_ntz").alias("month")).agg(F.count("*").alias("used"))


@query("X11_monthly_quota", "SELECT user_id, event_type, date_trunc('month', ts) AS month, count(*) AS used FROM events GROUP BY 1, 2, 3")
def _(t):
    return monthly_use(t.events, ["user_id", "event_type"], "ts")


@query("X12_tumbling_extension", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    w = t.events.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(
    "X13_session_extension",
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh, event_id FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, sid",
)
def _(t):
    w = t.events.groupBy(F.session_window("ts", "2 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


# -- streams ------------------------------------------------------------------


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What a stream gives over the input there is: it runs with ``availableNow`` into a memory table of that name."""
    run = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.table(name)


def stream_of(spark: SparkSession, folder: str, table: str, files_per_trigger: int = 1) -> DataFrame:
    """A file source over a table's folder; what a checkpoint has seen is not read again."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", f"{table}*.parquet").parquet(folder)


def stream_dedup(stream: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key; state goes when the watermark has passed."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def stream_windows(stream: DataFrame, ts: str, width: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Tumbling counts with a watermark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).count()


def stream_cooldown(stream: DataFrame, key: str, ts: str, minutes: int, tie: str | None = None, late: str | None = None) -> DataFrame:
    """X5 on a stream: (key, ts, tie) of the rows that fire, as ``first_of_bursts`` has them for rows in order; a key's state goes when the watermark has passed
    its cooldown. A row that comes late, before the one that fired last, does not fire."""
    stream = stream if tie else stream.withColumn("tie_", F.lit(0))
    tie = tie or "tie_"
    columns = ", ".join(f"{c} {stream.schema[c].dataType.simpleString()}" for c in (key, ts, tie))
    return processed(stream, Cooldown(key, ts, tie, minutes), columns, late or f"{minutes} minutes")
