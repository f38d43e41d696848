"""Registered streams: run over all input that is there, then checked like the batch form."""

from pyspark.sql import functions as F

from ..functions import dates
from ..session import work_path
from ..sources import mailbox
from ..streaming import jobs as streams
from ..streaming import late
from .checks_labels import UPSERT_COLUMNS, UPSERT_SQL, _ledger_and_batch
from .registry import register, rounded
from .views import AS_OF, MSG_SQL, PRED_SQL, TX_SQL, msg, pred, table, tx


def _finish(query):
    query.awaitTermination()
    return query


def _as_stream(spark, df, name, key, files=6):
    """A table as a folder of files, read as a stream of ``files / 2`` batches. Each of the files is as many as a batch needs
    to keep all cores busy; rows of one key are in one of them."""
    path, each = work_path(spark, name), max(1, spark.sparkContext.defaultParallelism // 2)
    df.repartition(files * each, key).write.parquet(path)
    return streams.read_stream(spark, path, df.schema, files_per_trigger=2 * each)


@register(
    "r1_streamed_extraction",
    "SELECT id, parse_status, template_used, amount, account, vendor, date FROM msg",
    [MSG_SQL],
)
def r1(spark, sf):
    source = _as_stream(spark, msg(spark, sf), "r1-in", "id", files=4)
    out = work_path(spark, "r1-out")
    _finish(streams.start_extract(source, AS_OF, out, work_path(spark, "r1-state")))
    return spark.read.parquet(out).select("id", "parse_status", "template_used", "amount", "account", "vendor", "date")


@register(
    "r1_streamed_mailbox",
    "SELECT id, md5(concat(CAST(o_orderkey % 3 AS VARCHAR), CAST(o_custkey AS VARCHAR))) AS digest FROM (SELECT CAST(o_orderkey AS VARCHAR) AS id, * FROM orders WHERE o_orderkey % 4 <> 0)",
)
def r1_mailbox(spark, sf):
    """Three syncs of the mailbox arrive while one stream goes on from where it stopped."""
    path, out, state = (work_path(spark, f"r1-mailbox-{n}") for n in ("in", "out", "state"))
    for sync in range(3):
        mailbox.write_pages(msg(spark, sf).filter(F.col("id").cast("bigint") % 3 == sync), f"{path}/sync={sync}")
        arriving = mailbox.stream_mailbox(spark, path, folder="INBOX").select("id", F.md5(F.concat(F.lit(str(sync)), "user_id")).alias("digest"))
        _finish(arriving.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out))
    return spark.read.parquet(out)


@register("r2_streamed_duplicates", "SELECT transaction_id, created_at FROM pred", [PRED_SQL])
def r2(spark, sf):
    rows = pred(spark, sf).select("transaction_id", "created_at")
    source = _as_stream(spark, rows.unionByName(rows), "r2-in", "transaction_id")
    out = work_path(spark, "r2-out")
    _finish(streams.start_unique(source, out, work_path(spark, "r2-state")))
    return streams.read_unique(spark, out)


@register("r3_streamed_upsert", UPSERT_SQL, [TX_SQL])
def r3(spark, sf):
    """Half of the changes are compacted into a snapshot; the others come later in the same stream and are applied on reading."""
    old, batch = _ledger_and_batch(spark, sf)
    path, source, state = work_path(spark, "r3"), work_path(spark, "r3-in"), work_path(spark, "r3-state")
    for half in (1, 2):
        batch.filter(F.col("seq") == half).repartition(4, "transaction_id").write.mode("append").parquet(source)
        arriving = streams.read_stream(spark, source, batch.schema, files_per_trigger=2)
        _finish(streams.start_upsert(arriving, old, path, state))
        if half == 1:
            streams.compact(spark, path, AS_OF, ["seq"])
    return streams.current_ledger(spark, path, AS_OF, ["seq"]).select(*UPSERT_COLUMNS)


@register(
    "r4_streamed_hourly_metrics",
    """SELECT date_trunc('hour', created_at) AS hour, model_version, count(*) AS predictions, floor(avg(prediction_confidence) * 1e6 + 0.5) / 1e6 AS avg_confidence
    FROM pred GROUP BY 1, 2 HAVING date_trunc('hour', created_at) + INTERVAL 1 HOUR <= (SELECT max(created_at) FROM pred) - INTERVAL 1 HOUR""",
    [PRED_SQL],
)
def r4(spark, sf):
    """Every third day arrives in one batch, so that the days of the second and third come after their hours were closed.
    The rows of an hour stay together in time order: sums of doubles depend on it in the last place."""
    events = pred(spark, sf)
    source, out, state = work_path(spark, "r4-in"), work_path(spark, "r4-out"), work_path(spark, "r4-state")
    for turn in (2, 1, 0):
        day = F.coalesce(F.datediff("created_at", F.lit("1970-01-01").cast("date")), F.lit(0))
        arriving = events.filter(F.pmod(day, F.lit(3)) == turn).repartitionByRange(4, F.date_trunc("day", "created_at"))
        arriving.sortWithinPartitions("created_at").write.mode("append").parquet(source)
        _finish(streams.start_hourly_metrics(streams.read_stream(spark, source, events.schema), out, state))
    return rounded(streams.read_hourly_metrics(spark, out), "avg_confidence")


@register(
    "r5_streamed_category_counts",
    """SELECT user_id, coalesce(user_category, predicted_category, 'Uncategorized') AS category, count(*) AS transaction_count,
    max(last_modified) AS last_used FROM tx GROUP BY 1, 2""",
    [TX_SQL],
)
def r5(spark, sf):
    rows = tx(spark, sf).select("user_id", "user_category", "predicted_category", "last_modified", "transaction_id")
    # every transaction was sent before, under another category
    before = rows.withColumns({"user_category": F.lit("first guess"), "last_modified": F.col("last_modified") - F.expr("INTERVAL 1 DAY")})
    source = _as_stream(spark, before.unionByName(rows).unionByName(rows), "r5-in", "transaction_id")
    out = work_path(spark, "r5-out")
    _finish(streams.start_category_counts(source, out, work_path(spark, "r5-state")))
    return streams.read_category_counts(spark, out)


@register(
    "r6_late_rows",
    "SELECT event_id, ts < TIMESTAMP '2024-01-10' AS late FROM events",
)
def r6(spark, sf):
    on_time, late = streams.split_late(table(spark, sf, "events"), "ts", dates.as_clock("2024-01-10 00:00:00"))
    return on_time.select("event_id", F.lit(False).alias("late")).unionByName(late.select("event_id", F.lit(True).alias("late")))


# ------------------------------------------------------------------------------------- streams behind a watermark

# Days arrive in three turns, those with number 2 modulo 3 first, so that most days of the later turns are behind the
# watermark. Late is what the newest time of the turns before, less an hour, has reached.
_TURNS = (2, 1, 0)
_DAY_SQL = "(CAST(created_at AS DATE) - DATE '1970-01-01') % 3"
_LATE_SQL = """turns AS (SELECT *, {day} AS turn FROM pred),
  behind AS (SELECT t.*, epoch_ms(t.created_at) <= (SELECT max(epoch_ms(b.created_at)) - 3600000 FROM turns b WHERE b.turn > t.turn) AS late FROM turns t)""".format(day=_DAY_SQL)


def _in_turns(spark, rows, name, start):
    """Write the rows of one turn after the other to a folder and run a stream over it each time."""
    source = work_path(spark, f"{name}-in")
    day = F.coalesce(F.datediff("created_at", F.lit("1970-01-01").cast("date")), F.lit(0))
    for turn in _TURNS:
        arriving = rows.filter(F.pmod(day, F.lit(3)) == turn).repartitionByRange(4, F.date_trunc("day", "created_at"))
        arriving.sortWithinPartitions("created_at").write.mode("append").parquet(source)
        start(streams.read_stream(spark, source, rows.schema))


def _routed(spark, rows, name, until=None, then=None):
    """The router's folder; ``then`` starts the stream on it after each turn."""
    out, state = work_path(spark, f"{name}-routed"), work_path(spark, f"{name}-router")

    def start(source):
        _finish(late.start_router(source, "created_at", "1 hour", out, state, until))
        if then:
            _finish(then(late.in_time(spark, out, rows.schema)))

    _in_turns(spark, rows, name, start)
    return out


@register(
    "r6_routed_rows",
    "SELECT transaction_id, created_at, coalesce(late, false) AS late FROM behind",
    [PRED_SQL, _LATE_SQL],
)
def r6_routed(spark, sf):
    rows = pred(spark, sf).select("transaction_id", "created_at")
    return late.read_routed(spark, _routed(spark, rows, "r6"), rows.schema)


@register("r2_unique_within_watermark", "SELECT transaction_id, created_at FROM pred", [PRED_SQL])
def r2_within(spark, sf):
    """Every row comes twice; the copies of late rows are late too."""
    rows = pred(spark, sf).select("transaction_id", "created_at")
    out, state = work_path(spark, "r2-within-out"), work_path(spark, "r2-within-state")
    routed = _routed(spark, rows.unionByName(rows), "r2-within", then=lambda arrived: late.start_unique_within(arrived, "created_at", "1 hour", out, state))
    return late.read_unique_within(spark, out, routed, rows.schema, "created_at")


@register(
    "r4_closed_hours",
    """SELECT date_trunc('hour', created_at) AS hour, model_version, count(*) AS predictions, floor(avg(prediction_confidence) * 1e9 + 0.5) / 1e9 AS avg_confidence
    FROM pred GROUP BY 1, 2 HAVING date_trunc('hour', created_at) + INTERVAL 1 HOUR <= (SELECT max(created_at) FROM pred) - INTERVAL 1 HOUR""",
    [PRED_SQL],
)
def r4_closed(spark, sf):
    """Hours of the first turn are closed by the stream; most others are late and folded in by the batch job. Means of these
    values do not end in a five at the tenth place, so the order of their sums does not show."""
    rows = pred(spark, sf)
    out, state = work_path(spark, "r4-closed-out"), work_path(spark, "r4-closed-state")
    start = lambda arrived: late.start_closed_hours(arrived, "1 hour", out, state, every=2)
    routed = _routed(spark, rows, "r4-closed", late.hour_end("created_at"), start)
    late.fold_late_hours(late.late_rows(spark, routed, rows.schema), out)
    return rounded(late.read_closed_hours(spark, out), "avg_confidence", places=9)


@register(
    "r5_running_counts",
    """SELECT user_id, coalesce(user_category, predicted_category, 'Uncategorized') AS category, count(*) AS transaction_count,
    max(last_modified) AS last_used FROM tx GROUP BY 1, 2""",
    [TX_SQL],
)
def r5_running(spark, sf):
    """Every transaction was sent before, under another category, and comes twice."""
    rows = tx(spark, sf).select("user_id", "user_category", "predicted_category", "last_modified", "transaction_id")
    before = rows.withColumns({"user_category": F.lit("first guess"), "last_modified": F.col("last_modified") - F.expr("INTERVAL 1 DAY")})
    source = _as_stream(spark, before.unionByName(rows).unionByName(rows), "r5-running-in", "transaction_id")
    out = work_path(spark, "r5-running-out")
    _finish(late.start_running_counts(source, out, work_path(spark, "r5-running-state"), every=2))
    return late.read_running_counts(spark, out)
