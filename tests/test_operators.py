"""Properties of the operators that a single SQL check does not show."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import common, labels, ledger, model, reports, rules, sampling
from ledgerloom.plans import jobs, views
from ledgerloom.plans.checks_labels import _ledger_and_batch
from ledgerloom.session import work_path
from ledgerloom.sources import readers, writers
from ledgerloom.streaming import jobs as streams

AS_OF = views.AS_OF


def rows(df):
    return sorted(map(repr, df.collect()))


def test_upsert_twice_is_upsert_once(spark, sf):
    old, batch = _ledger_and_batch(spark, sf)
    once = ledger.upsert(old, batch, AS_OF, order=["seq"])
    assert rows(ledger.upsert(once, batch, AS_OF, order=["seq"])) == rows(once)


def test_balanced_sizes(spark, sf):
    df = views.td(spark, sf)
    counts = {r.category: r for r in df.groupBy("category").agg(F.count("*").alias("n"), F.count_if("is_user_corrected").alias("c")).collect()}
    cap = int(min(r.n for r in counts.values()) * 1.2)
    for r in sampling.balance_categories(df, 1.2).groupBy("category").count().collect():
        assert r["count"] == min(counts[r.category].n, max(cap, counts[r.category].c))


def test_one_category_is_not_balanced(spark, sf):
    df = views.td(spark, sf).withColumn("category", F.lit("one"))
    assert sampling.balance_categories(df).count() == df.count()


def test_split_is_exact_and_in_time_order(spark, sf):
    df = views.td(spark, sf)
    parts = sampling.split_by_time(df)
    n = df.count()
    assert parts.count() == n and parts.filter("is_train").count() == int(n * 0.8)
    edge = parts.agg(F.max(F.when(F.col("is_train"), F.col("date"))).alias("a"), F.min(F.when(~F.col("is_train"), F.col("date"))).alias("b")).first()
    assert edge.a <= edge.b


def test_split_with_missing_dates_and_microseconds(spark):
    df = spark.range(1000).select(
        F.col("id").cast("string").alias("transaction_id"),
        F.when(F.col("id") % 10 != 0, F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id % 7 / 1000000)")).alias("date"),
    )
    parts = sampling.split_by_time(df, 0.5)
    assert parts.filter("is_train").count() == 500
    want = sorted(
        df.withColumn("k", sampling.sample_key(F.col("transaction_id"))).collect(), key=lambda r: (r.date is not None, r.date or 0, r.k)
    )
    assert {r.transaction_id for r in want[:500]} == {r.transaction_id for r in parts.filter("is_train").collect()}


def test_split_cut_is_found_whatever_the_bracket(spark, monkeypatch):
    df = spark.range(2000).select(
        F.col("id").cast("string").alias("transaction_id"),
        F.expr("CASE WHEN id % 3 = 0 THEN timestamp_ntz'2024-01-01 12:00:00' WHEN id % 50 <> 1 THEN timestamp_ntz'2000-01-01' + make_dt_interval(id % 900 * 11, id % 24) END").alias("date"),
    ).cache()
    rows = df.withColumn("k", sampling.sample_key(F.col("transaction_id"))).collect()
    rows.sort(key=lambda r: (r.date is not None, r.date or 0, r.k))
    monkeypatch.setattr(sampling, "EDGE", 5)
    monkeypatch.setattr(sampling, "CELLS", 16)
    found = sampling.bracket
    for share in (0.0, 0.005, 0.02, 0.5, 0.8, 1.0):
        for shift in (0, -(10**15), 10**15):  # a sketch that is wrong
            monkeypatch.setattr(sampling, "bracket", lambda *a: (found(*a)[0], *(q if q < 0 else q + shift for q in found(*a)[1:])))
            taken = {r.transaction_id for r in sampling.split_by_time(df, share).filter("is_train").collect()}
            assert taken == {r.transaction_id for r in rows[: int(2000 * share)]}, (share, shift)
    nothing = sampling.split_by_time(df.limit(0))
    assert nothing.columns == [*df.columns, "is_train"] and nothing.count() == 0


def test_rows_are_numbered_in_order_without_one_task(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("v"), F.lit(1).alias("_n"))
    got = common.numbered(df.orderBy(F.desc("v")), "place").collect()
    assert sorted((r.place, r.v) for r in got) == [(i + 1, 4999 - i) for i in range(5000)]
    assert common.numbered(df.limit(0), "place").count() == 0


def test_short_names_rank_by_number(spark):
    rowset = [(f"transaction_model_v{v}", "a", "a" if v != 9 else "b", "2024-01-30 10:00:00") for v in (8, 9, 10)]
    fb = spark.createDataFrame(rowset, "model_version string, original_category string, user_category string, t string").withColumn(
        "feedback_timestamp", F.col("t").cast("timestamp_ntz")
    )
    assert [r.model_version for r in reports.model_performance(fb, AS_OF).collect()] == ["transaction_model_v10", "transaction_model_v9"]
    assert [r.model_version for r in reports.model_performance(fb, AS_OF, order="name").collect()] == ["transaction_model_v9", "transaction_model_v8"]
    assert reports.promotion_decision(fb, AS_OF).first().status == "promoted"
    assert reports.promotion_decision(fb.filter("model_version LIKE '%v8'"), AS_OF).first().new_model_accuracy == 0.0


def test_exactly_five_points_is_no_drift(spark):
    entries = [("m", "a", "a" if i < 17 else "b", "2024-01-30 12:00:00") for i in range(20)]
    entries += [("m", "a", "a" if i < 18 else "b", "2024-01-28 12:00:00") for i in range(20)]
    fb = spark.createDataFrame(entries, "model_version string, original_category string, user_category string, t string").withColumn(
        "feedback_timestamp", F.col("t").cast("timestamp_ntz")
    )
    row = reports.model_drift(fb, AS_OF).first()
    assert str(row.accuracy_change) == "-0.050" and row.drift_detected is False


def test_reports_on_no_rows(spark, sf):
    none = views.fb(spark, sf).limit(0)
    stats = reports.feedback_stats(none, AS_OF).first()
    assert (stats.total_feedback, stats.avg_confidence, stats.accuracy_rate) == (0, 0.0, 0.0)
    assert reports.next_version(spark.createDataFrame([], "model_id string")).first().next_version == 1


def test_missing_columns_are_refused(spark, sf):
    with pytest.raises(ValueError, match="amount"):
        rules.prepare_training_rows(views.tx(spark, sf).drop("amount"))
    assert reports.missing_columns(views.tx(spark, sf).drop("user_category")) == [("category", "predicted_category")]


def test_prepared_rows_fill_what_is_missing(spark, sf):
    bare = views.tx(spark, sf).drop("template_used", "user_id", "user_category", "user_subcategory").withColumn("user_feedback", F.lit('{"corrected": true}'))
    row = rules.prepare_training_rows(bare).first()
    assert row.user_id == "unknown" and row.template_used == "GENERIC_TEMPLATE" and row.is_user_corrected is True


def test_type_errors(spark, sf):
    assert rules.type_errors(views.tx(spark, sf)) == []
    assert rules.type_errors(views.tx(spark, sf).withColumn("tags", F.lit("x")))[0].startswith("Invalid type for tags")


def test_golden_feature_row(spark):
    df = spark.createDataFrame([("Sams Online", "Discover", "4393", "2025-07-27")], "vendor string, template_used string, account string, d string")
    row = rules.feature_rows(df.withColumn("date", F.col("d").cast("timestamp_ntz")), AS_OF).first()
    assert tuple(row)[:2] == ("sams online", "sams online") and row.cleaned_metaphone.startswith("SMSN")
    assert tuple(row)[3:] == ("Discover", "4393", "27", "7", "2025", "Sunday", 0, 0, 0, 0, 0, 0, 0, 0, 0)


INGEST = "request_id long, row_index long, user_id string, id string, vendor string, amount double, date string, account string, template_used string"


def ingest_row(request, index, user="u1", vendor="WHOLE FOODS"):
    return (request, index, user, f"cl_{index}", vendor, 47.23, "2026-02-04T15:30:00+00:00", "CB_1234", "Coinbase One Credit Card")


def test_ingest_requests(spark):
    df = spark.createDataFrame(
        [ingest_row(1, 0), ingest_row(1, 1, vendor=None), ingest_row(2, 0), ingest_row(2, 1), ingest_row(3, 0, user=None)], INGEST
    )
    assert {r.request_id for r in rules.accept_requests(df).collect()} == {2}
    errors = {r.request_id: (r.row_index, r.error) for r in rules.ingest_errors(df).collect()}
    assert errors == {1: (1, "missing fields: vendor"), 3: (0, "Missing required field: user_id")}


def test_confirmations_are_optional_feedback(spark, sf):
    base = views.tx(spark, sf)
    agreed = base.select("transaction_id", "user_id", F.col("predicted_category").alias("new_category"), F.lit(None).cast("string").alias("new_subcategory"),
                         F.col("date").alias("corrected_at"))
    assert labels.feedback_rows(base, agreed).count() == 0
    assert labels.feedback_rows(base, agreed, include_confirmations=True).count() == base.count()


def test_empty_training_folder_is_refused(spark):
    path = work_path(spark, "empty")
    spark.createDataFrame([], "a string").write.parquet(path)
    with pytest.raises(ValueError):
        readers.read_training_parts(spark, path)


def test_replaced_days_keep_the_other_days(spark):
    path = work_path(spark, "days")
    days = spark.range(4).select("id", F.expr("timestamp_ntz'2024-01-01 10:00:00' + make_dt_interval(cast(id as int))").alias("date"))
    writers.replace_days(days, path, "date")
    writers.replace_days(days.filter("id = 2").withColumn("id", F.lit(20).cast("long")), path, "date")
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [0, 1, 3, 20]


def test_repeated_stream_batch_changes_nothing(spark, sf):
    old, batch = _ledger_and_batch(spark, sf)
    path = work_path(spark, "replay")
    old.write.parquet(f"{path}/ledger/upto=-1")
    for _ in range(2):
        streams.save_changes(path)(batch, 0)
    want = rows(ledger.upsert(old, batch, AS_OF, ["seq"]))
    assert rows(streams.current_ledger(spark, path, AS_OF, ["seq"])) == want
    streams.compact(spark, path, AS_OF, ["seq"])
    streams.compact(spark, path, AS_OF, ["seq"])
    assert rows(streams.current_ledger(spark, path, AS_OF, ["seq"])) == want


def test_late_predictions_are_counted_in_their_hour(spark):
    ddl = "created_at string, model_version string, prediction_confidence double"
    path, out, state = (work_path(spark, f"late-{n}") for n in ("in", "out", "state"))
    batches = [
        [("2024-01-01 10:05:00", "m1", 0.5), ("2024-01-01 15:00:00", "m1", 0.9), ("2024-01-01 14:00:00", "m1", 0.7)],
        [("2024-01-01 10:10:00", "m1", 0.7), ("2024-01-01 10:59:59", "m2", None), ("2024-01-01 13:59:59", "m1", 0.4), (None, "m1", 0.1)],
    ]
    for batch in batches:
        df = spark.createDataFrame(batch, ddl).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
        df.coalesce(1).write.mode("append").parquet(path)
        streams.start_hourly_metrics(streams.read_stream(spark, path, df.schema), out, state).awaitTermination()
    got = {(r.hour.hour, r.model_version): (r.predictions, r.avg_confidence) for r in streams.read_hourly_metrics(spark, out).collect()}
    assert got == {(10, "m1"): (2, pytest.approx(0.6)), (10, "m2"): (1, None), (13, "m1"): (1, pytest.approx(0.4))}


def test_folded_changes_equal_applying_them_in_turn(spark):
    ddl = "user_id string, transaction_id string, vendor string, amount double, predicted_category string, model_version string, seq int"
    old = spark.createDataFrame([("u", "1", "old", 1.0, "a", "m1", 0), ("u", "2", "old", 1.0, "a", "m1", 0)], ddl).drop("seq")
    changes = [("u", "1", "x", None, None, "m9", 1), ("u", "1", None, 3.0, "b", None, 2), ("u", "3", "n", 4.0, None, None, 1)]
    turn = old
    for row in changes:
        turn = ledger.upsert(turn, spark.createDataFrame([row], ddl), AS_OF)
    assert rows(ledger.upsert(old, spark.createDataFrame(changes, ddl), AS_OF, ["seq"])) == rows(turn)


def test_model_is_repeatable_and_beats_the_majority(spark, sf):
    from ledgerloom.plans.checks_jobs import SMALL, _labelled

    data = sampling.with_weights(_labelled(spark, sf)).cache()
    parts = sampling.split_by_time(data)
    one, two = (model.fit(parts.filter("is_train"), parts.filter("NOT is_train"), SMALL) for _ in range(2))
    assert rows(one.predictions.select("transaction_id", "predicted_category")) == rows(two.predictions.select("transaction_id", "predicted_category"))
    top = data.groupBy("category").count().orderBy(F.desc("count")).first()["count"] / data.count()
    assert one.accuracy().filter("target = 'category'").first().accuracy > top


def test_model_queries_run_with_the_default_sizes(spark, sf, monkeypatch):
    from ledgerloom.plans import checks_jobs

    used = []

    def stop(*args, **named):
        used.extend(a for a in [*args, *named.values()] if isinstance(a, model.Settings))
        raise InterruptedError

    for name in ("fit", "fit_features"):
        monkeypatch.setattr(model, name, stop)
    for query in (checks_jobs.m1, checks_jobs.m2, checks_jobs.m3, checks_jobs.m4, checks_jobs.m6, checks_jobs.m10, checks_jobs.b4):
        with pytest.raises(InterruptedError):
            query(spark, sf)
    assert len(used) == 7 and all(s == model.Settings(as_of=AS_OF) for s in used)


def test_training_needs_two_categories_and_all_columns(spark, sf):
    data = views.td(spark, sf)
    with pytest.raises(ValueError, match="two categories"):
        jobs.train(data.withColumn("category", F.lit("one")))
    with pytest.raises(ValueError, match="Missing required columns"):
        jobs.train(data.drop("amount"))


def test_export_reads_only_the_wanted_days(spark, sf, tmp_path):
    from ledgerloom.sources import writers

    rows = views.td(spark, sf).withColumn("category", F.coalesce("category", F.lit("x")))
    writers.write_training_table(rows, str(tmp_path / "table"))
    table = writers.read_training_table(spark, str(tmp_path / "table"), rows.schema, F.lit("1998-01-01").cast("date"))
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date_day" in plan
    assert table.count() == rows.filter("date >= '1998-01-01'").count()


def test_upsert_leaves_untouched_partitions(spark, tmp_path):
    import glob

    from ledgerloom.operators import ledger

    path = str(tmp_path / "ledger")
    ledger.create_table(spark.createDataFrame([(f"u{i}", "t", "A") for i in range(40)], "user_id string, transaction_id string, vendor string"), path, 8)
    before = set(glob.glob(f"{path}/*/*.parquet"))
    ledger.upsert_table(path, spark.createDataFrame([("u3", "t", "B"), ("u3", "new", "C")], "user_id string, transaction_id string, vendor string"), AS_OF, buckets=8)
    after = set(glob.glob(f"{path}/*/*.parquet"))
    assert len({f.split("/")[-2] for f in before - after}) == 1 and len({f.split("/")[-2] for f in before & after}) >= 5
    rows = {(r.user_id, r.transaction_id): r.vendor for r in ledger.read_table(spark, path).collect()}
    assert len(rows) == 41 and rows["u3", "t"] == "B" and rows["u3", "new"] == "C" and rows["u4", "t"] == "A"


def test_repeated_changes_of_a_new_row_keep_its_first_notes(spark):
    from ledgerloom.operators import ledger

    old = spark.createDataFrame([], "user_id string, transaction_id string, vendor string, notes string")
    batch = spark.createDataFrame([("u", "t", 1, "A", "first"), ("u", "t", 2, "B", "second")], "user_id string, transaction_id string, seq int, vendor string, notes string")
    row = ledger.upsert(old, batch, AS_OF, ["seq"]).first()
    assert (row.vendor, row.notes) == ("B", "first")


def test_fractions_of_a_second_stay(spark):
    import datetime as dt

    parsed = spark.createDataFrame(
        [("m", "i", "u", "1234", "T", dt.datetime(2024, 1, 2, 10, 0, 0, 123456), 5.0, "SHOP", "ok")],
        "message_id string, id string, user_id string, account string, template_used string, date timestamp_ntz, amount double, vendor string, parse_status string",
    )
    row = jobs.stage_transactions(parsed).first()
    assert row.date == dt.datetime(2024, 1, 2, 10, 0, 0, 123456) and row.errors == []


def test_work_folder_is_shared_or_temporary(spark, monkeypatch):
    from ledgerloom import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Far:
        conf = Conf()

        class sparkContext:
            master = "spark://far:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.work_path(Far(), "x")
    path = session.work_path(spark, "x")
    spark.range(3).write.parquet(path)
    session.clear_work(spark)
    import os

    assert not os.path.exists(path)


def test_retraining_needs_feedback(spark, sf):
    assert jobs.retrain(spark, views.td(spark, sf), views.fb(spark, sf).limit(0), "/nowhere", "/nowhere", AS_OF) is None


def test_small_sides_only_are_broadcast(spark, sf):
    """No plan forces a broadcast; the planner may choose one by size."""
    import pathlib

    import ledgerloom

    code = "".join(p.read_text() for p in pathlib.Path(ledgerloom.__file__).parent.rglob("*.py"))
    assert "F.broadcast" not in code and "crossJoin" not in code and "localCheckpoint" not in code


def test_extract_and_load_with_a_scorer(spark, sf):
    scorer = lambda df: df.withColumns(
        {"category": F.lit("Food"), "subcategory": F.lit("Shop"), "confidence": F.lit(0.9), "model_version": F.lit("transaction_model_v1")}
    )
    empty = views.tx(spark, sf).limit(0).withColumns({"created_at": F.col("date"), "status": F.lit(""), "id_api": F.lit("")})
    loaded = jobs.extract_and_load(views.msg(spark, sf), empty, AS_OF, views.usr(spark, sf), scorer)
    row = loaded.ledger.agg(F.count("*").alias("n"), F.min("predicted_category").alias("c"), F.max("model_version").alias("m")).first()
    assert row.n == loaded.accepted.count() > 0 and (row.c, row.m) == ("Food", "transaction_model_v1")
    assert loaded.rejected.filter("reason = 'no_template'").count() > 0


# streams behind a watermark


def _arrive(spark, path, values, ddl):
    df = spark.createDataFrame(values, ddl)
    for field in df.schema.fields:
        if field.name in ("created_at", "last_modified"):
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp_ntz"))
    df.coalesce(2).write.mode("append").parquet(path)
    return df.schema


def test_rows_behind_the_watermark_are_late_and_none_is_lost(spark):
    from ledgerloom.streaming import late

    source, out, state = (work_path(spark, f"router-{n}") for n in ("in", "out", "state"))
    turns = [[("a", "2024-01-01 10:00:00"), ("b", "2024-01-01 12:00:00")], [("c", "2024-01-01 11:00:00"), ("d", "2024-01-01 11:00:01"), ("e", None)], [("f", "2024-01-01 10:30:00")]]
    for turn in turns:
        schema = _arrive(spark, source, turn, "transaction_id string, created_at string")
        late.start_router(streams.read_stream(spark, source, schema), "created_at", "1 hour", out, state).awaitTermination()
    got = {r.transaction_id: r.late for r in late.read_routed(spark, out, schema).collect()}
    assert got == {"a": False, "b": False, "c": True, "d": False, "e": True, "f": True}


def test_duplicates_are_dropped_with_bounded_state_and_late_ones_by_the_table(spark):
    from ledgerloom.streaming import late

    source, routed, out = (work_path(spark, f"within-{n}") for n in ("in", "routed", "out"))
    states = [work_path(spark, f"within-state-{n}") for n in (1, 2)]
    for day in range(1, 7):
        rows = [(f"{day}-{n}", f"2024-01-{day:02d} {n:02d}:00:00") for n in range(24)]
        rows += rows[:5] + [(f"{day - 1}-7", f"2024-01-{day - 1:02d} 07:00:00"), (f"late-{day}", "2024-01-01 00:00:00"), (f"late-{day - 1}", "2024-01-01 00:00:00")] * (day > 1)
        schema = _arrive(spark, source, rows, "transaction_id string, created_at string")
        late.start_router(streams.read_stream(spark, source, schema), "created_at", "1 hour", routed, states[0]).awaitTermination()
        query = late.start_unique_within(late.in_time(spark, routed, schema), "created_at", "1 hour", out, states[1])
        query.awaitTermination()
        held = max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"])
        assert held <= 2 * 24  # of a day and the one before, however many days there are
    got = [r.transaction_id for r in late.read_unique_within(spark, out, routed, schema, "created_at").collect()]
    assert len(got) == len(set(got)) and set(got) == {f"{d}-{n}" for d in range(1, 7) for n in range(24)} | {f"late-{d}" for d in range(1, 7)}


def test_running_counts_follow_corrections_and_output_stays_small(spark):
    import glob

    from ledgerloom.streaming import late

    source, out, state = (work_path(spark, f"running-{n}") for n in ("in", "out", "state"))
    ddl = "user_id string, transaction_id string, user_category string, predicted_category string, last_modified string"
    for batch in range(12):
        at = f"2024-01-{batch + 1:02d} 00:00:00"
        rows = [("u", "1", None, f"c{batch % 3}", at), ("u", "2", "fixed", None, "2024-01-05 00:00:00"), ("v", "1", None, None, None), ("v", "9", None, "old", "2023-01-01 00:00:00")]
        if batch == 11:
            rows += [("v", "9", None, "older", "2022-01-01 00:00:00"), ("v", "8", "x", None, at), ("v", "8", "y", None, "2024-02-01 00:00:00")]
        schema = _arrive(spark, source, rows, ddl)
        late.start_running_counts(streams.read_stream(spark, source, schema), out, state, every=3).awaitTermination()
    got = {(r.user_id, r.category): (r.transaction_count, str(r.last_used)) for r in late.read_running_counts(spark, out).collect()}
    assert got == {
        ("u", "c2"): (1, "2024-01-12 00:00:00"), ("u", "fixed"): (1, "2024-01-05 00:00:00"), ("v", "Uncategorized"): (1, "None"),
        ("v", "old"): (1, "2023-01-01 00:00:00"), ("v", "y"): (1, "2024-02-01 00:00:00"),
    }
    assert len(glob.glob(f"{out}/*=*")) <= 8


def test_a_batch_repeated_after_folding_changes_nothing(spark):
    import glob

    from ledgerloom.operators.common import latest_by

    out, ddl = work_path(spark, "folded"), "user_id string, transaction_id string, predicted_category string, last_modified string"
    newest = lambda rows: latest_by(rows, ["user_id", "transaction_id"], ["last_modified"])
    batches = [spark.createDataFrame([("u", str(n), f"c{b}", f"2024-01-0{b + 1}") for n in range(b, 9, b + 1)], ddl) for b in range(5)]
    save = streams.parts.save_part(out, newest, streams._newest_of_each, every=100)
    for number, batch in enumerate(batches):
        save(batch, number)
    want = rows(streams.read_category_counts(spark, out))
    assert sum(r.transaction_count for r in streams.read_category_counts(spark, out).collect()) == 9
    streams.compact_category_rows(spark, out)
    assert rows(streams.read_category_counts(spark, out)) == want
    save(batches[-1], 4)  # the batch was not committed before a crash
    assert rows(streams.read_category_counts(spark, out)) == want
    streams.compact_category_rows(spark, out)
    save(batches[0], 5)
    streams.compact_category_rows(spark, out)
    assert rows(streams.read_category_counts(spark, out)) == want and len(glob.glob(f"{out}/*=*")) <= 4


def test_compaction_removes_what_no_reader_needs(spark, sf):
    import glob

    old, batch = _ledger_and_batch(spark, sf)
    path = work_path(spark, "removed")
    old.write.parquet(f"{path}/ledger/upto=-1")
    for number in range(6):
        streams.save_changes(path)(batch, number)
        streams.compact(spark, path, AS_OF, ["seq"])
        assert len(glob.glob(f"{path}/changes/batch=*")) <= 2 and len(glob.glob(f"{path}/ledger/upto=*")) <= 2
    assert rows(streams.current_ledger(spark, path, AS_OF, ["seq"])) == rows(ledger.upsert(old, batch, AS_OF, ["seq"]))


# the stored ledger and exports


def test_merge_shuffles_no_ledger_and_keeps_untouched_files(spark):
    import glob
    import re

    from ledgerloom.operators.ledger_table import LedgerTable

    ddl = "user_id string, transaction_id string, vendor string, amount double, date string, created_at string, last_modified string"
    moment = lambda df: df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("date", "created_at", "last_modified")})
    old = moment(spark.createDataFrame([(f"u{n % 7}", str(n), "old", 1.0, f"2024-{1 + n % 6:02d}-03", "2024-01-01", "2024-01-01") for n in range(120)] + [("u", "alone", "old", 1.0, "2023-01-01", "2024-01-01", None)], ddl))
    batch = moment(spark.createDataFrame([
        ("u1", "1", "new", 5.0, "2024-02-03", None, None), ("u9", "n1", "new", 2.0, "2024-03-01", None, None), ("u9", "n2", "new", 2.0, "2024-09-01", None, None),
        ("u", "alone", "moved", 2.0, "2024-02-09", None, None), ("u9", "n3", "new", 2.0, None, None, None),
    ], ddl)).drop("created_at", "last_modified")
    path = work_path(spark, "bucketed")
    table = LedgerTable.create(old, path, buckets=4)
    before = set(glob.glob(f"{path}/*/*.parquet"))
    months = table.months_of(batch)
    assert months == ["2023-01", "2024-02", "2024-03", "2024-09", "none"]
    plan = table.merged(batch, AS_OF, None, months)._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[-1]
    scan = next(i for i, line in enumerate(plan.splitlines()) if "Scan parquet" in line and "Bucketed: true" in line)
    lines = plan.splitlines()
    depth = lambda line: len(re.match(r"[ :+\-*()\d]*", line).group())
    above, at = [], depth(lines[scan])
    for line in reversed(lines[:scan]):  # the scan's ancestors
        if depth(line) < at:
            above.append(line)
            at = depth(line)
    assert any("SortMergeJoin" in line or "ShuffledHashJoin" in line for line in above) and not any("Exchange" in line for line in above)
    want = rows(ledger.upsert(old, batch, AS_OF))
    table.merge(batch, AS_OF)
    assert rows(table.read()) == want
    after = set(glob.glob(f"{path}/*/*.parquet"))
    assert {f.split("=")[1][:7] for f in before & after} == {"2024-01", "2024-04", "2024-05", "2024-06"}
    assert not any("2023-01" in f for f in after)
    table.merge(batch, AS_OF)
    assert rows(table.read()) == want
    spark.sql(f"DROP TABLE {table.name}")
    assert rows(LedgerTable(spark, path, buckets=4).read()) == want  # as another session opens it


def test_export_actions(spark, sf, tmp_path):
    import glob

    source = [views.tx(spark, sf), views.usr(spark, sf), views.fb(spark, sf)]
    table, files = str(tmp_path / "table"), str(tmp_path / "files")
    for as_of in ("2001-06-20 00:00:00", "2001-07-10 00:00:00", "2001-08-02 00:00:00"):
        out = jobs.export_all(*source, table, files, as_of)
    folders = sorted(f.split("/")[-1] for f in glob.glob(f"{files}/*=*"))
    assert folders == ["export_day=2001-07-10", "export_day=2001-08-02"]
    known, before = rows(out), set(glob.glob(f"{files}/**/*.parquet", recursive=True))
    stored = spark.read.parquet(table).count()
    jobs.export_incremental(source[0], source[1], table, "2001-08-02 00:00:00")
    assert rows(out) == known and set(glob.glob(f"{files}/**/*.parquet", recursive=True)) == before
    assert spark.read.parquet(table).count() > stored


def test_retention_drops_whole_days_and_keeps_other_files(spark, tmp_path):
    import datetime
    import glob

    from ledgerloom.sources import writers

    path = str(tmp_path / "days")
    writers.replace_days(spark.range(10).selectExpr("id", "if(id = 9, NULL, date_add(DATE '2024-01-01', CAST(id AS INT))) AS day"), path, "day")
    before = set(glob.glob(f"{path}/*/*.parquet"))
    assert writers.drop_days_before(spark, path, "date_day", datetime.date(2024, 1, 4)) == ["2024-01-01", "2024-01-02", "2024-01-03"]
    after = set(glob.glob(f"{path}/*/*.parquet"))
    assert after < before and sorted(r.id for r in spark.read.parquet(path).collect()) == [3, 4, 5, 6, 7, 8, 9]


def test_running_counts_keep_many_transactions_in_one_state(spark):
    from ledgerloom.streaming import late

    ddl = "user_id string, transaction_id string, predicted_category string, last_modified string"
    source, state, got = work_path(spark, "packed-in"), work_path(spark, "packed-state"), {}
    for batch in range(2):  # every transaction moves to another category in the second batch
        rows = [(f"u{i % 3}" if i % 3 else None, str(i), f"c{(i + batch) % 2}", f"2024-01-0{batch + 1} 00:00:00") for i in range(60)]
        changes = late.category_changes(streams.read_stream(spark, source, _arrive(spark, source, rows, ddl)), groups=2)
        save = lambda frame, n: got.setdefault(n, frame.groupBy("user_id", "category").agg(F.sum("change").alias("change")).collect())
        query = changes.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= 2
    users, categories = (None, "u1", "u2"), ("c0", "c1")
    assert {(r.user_id, r.category): r.change for r in got[0]} == {(u, c): 10 for u in users for c in categories}
    assert {(r.user_id, r.category): r.change for r in got[1]} == {(u, c): 0 for u in users for c in categories}


def test_forest_on_sparse_rows_splits_by_value_and_survives_saving(spark, tmp_path, monkeypatch):
    from pyspark.ml.linalg import Vectors

    from ledgerloom.operators import forest

    monkeypatch.setattr(forest, "CHUNK_ROWS", 64)  # several tasks
    # feature 7 below or above 0.5 decides the class, but for feature 30,000, which alone decides a third one
    data = [(i, Vectors.sparse(40_000, {7: (i % 100 + 1) / 100, **({30_000: 1.0} if i % 5 == 0 else {}), 100 + i: 1.0})) for i in range(600)]
    label = lambda i: 2 if i % 5 == 0 else int(i % 100 >= 50)
    frame = spark.createDataFrame([(i, v, label(i), 0, 1.0 + i % 2) for i, v in data], ["id", "features", "a_index", "b_index", "w"])
    fitted = forest.fit(frame, {"a_index": 3, "b_index": 1}, "w", F.xxhash64("id"), 20, 6, 42, 40)
    scored = fitted.transform(frame)
    got = {r.id: (r.a_prediction, r.b_prediction, sum(r.a_probability)) for r in scored.collect()}
    assert sum(got[i][0] == label(i) for i in range(600)) > 570
    assert all(b == 0 and total == pytest.approx(1) for _, b, total in got.values())
    assert len(fitted.trees["b_index"].feature) == 20  # one class: each tree is a leaf
    fitted.write().overwrite().save(str(tmp_path / "forest"))
    again = forest.ForestModel.load(str(tmp_path / "forest")).transform(frame)
    assert rows(again.select("id", "a_probability")) == rows(scored.select("id", "a_probability"))


def test_costly_rows_are_spread_and_terms_are_searched_for_once(spark, monkeypatch):
    monkeypatch.setattr(common, "ROWS_PER_TASK", 5)
    numbers = spark.range(0, 500, 1, 1).withColumn("k", F.col("id") % 7)
    assert common.spread(numbers).rdd.getNumPartitions() == 100
    assert rows(common.spread(numbers)) == rows(numbers)
    tasks = common.spread(numbers, "k").withColumn("task", F.spark_partition_id()).groupBy("k").agg(F.count_distinct("task").alias("n"))
    assert {r.n for r in tasks.collect()} == {1}
    found = spark.createDataFrame([("Big red  shop",), ("",), (None,)], "v string").select(model.terms(F.col("v")).alias("t"))
    assert [r.t for r in found.collect()] == [["big", "red", "shop", "big red", "red shop"], [], None]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 1  # none: computed from local rows


def test_held_out_rows_are_scored_once_for_all_reports(spark):
    scored = spark.range(4).select(F.uuid().alias("category"), F.lit("a").alias("predicted_category"))
    trained = model.Trained(None, scored, model.Settings())
    assert rows(trained.predictions) == rows(trained.predictions)


def test_forest_chunk_steps_rows_by_their_entries():
    import numpy as np

    from ledgerloom.operators import forest

    features = [[], [3, 5, 9], [5], [3, 9]]
    bins = [[], [1, 4, 31], [2], [0, 3]]
    flat = lambda lists, kind: np.array([x for part in lists for x in part], kind).tobytes()
    arrays = [
        np.arange(4, dtype=np.int64).tobytes(), np.array([len(f) for f in features], np.int32).tobytes(), flat(features, np.int32), flat(bins, np.uint8),
        np.arange(4, dtype=np.int32).tobytes(), np.arange(4, dtype=np.float64).tobytes(), np.zeros((2, 4), np.int32).tobytes(),
    ]
    chunk = forest._Chunk.of(dict(zip(forest.CHUNK.names, arrays)), 1)
    assert chunk.draw.tolist() == [1, 3, 2, 0] and chunk.counts.tolist() == [3, 2, 1]
    split = lambda feature, low: (np.array([feature], np.int32), np.array([low], np.int32), np.array([0], np.int32))
    moved = forest._moved(chunk, [split(5, 3), split(9, 3)])
    by_row = {int(d): moved.nodes[:, i].tolist() for i, d in enumerate(chunk.draw)}
    assert by_row == {0: [0, 0], 1: [1, 1], 2: [0, 0], 3: [0, 1]}
    leaf = (np.array([-1], np.int32), np.array([0], np.int32), np.array([-1], np.int32))
    assert (forest._moved(chunk, [leaf, split(9, 3)]).nodes[0] == -1).all()


def _forest_chunk(rows=400, features=60, seed=5):
    """A chunk of rows with up to a dozen entries, two classes of labels, and their entries as a dictionary a row."""
    import numpy as np

    from ledgerloom.operators import forest

    random = np.random.default_rng(seed)
    entries = [{int(f): int(b) for f, b in zip(random.choice(features, n, replace=False), random.integers(0, 4, n))} for n in random.integers(0, 12, rows)]
    labels, weights = random.integers(0, 3, (2, rows)).astype(np.int32), random.integers(1, 4, rows).astype(np.float64)
    flat = lambda pick, kind: np.array([x for e in entries for x in pick(dict(sorted(e.items())))], kind).tobytes()
    lengths, draw = np.array([len(e) for e in entries], np.int32), random.integers(0, 2**63, rows).astype(np.int64)
    arrays = [draw.tobytes(), lengths.tobytes(), flat(lambda e: e.keys(), np.int32), flat(lambda e: e.values(), np.uint8), labels.tobytes(), weights.tobytes(), b""]
    chunk = forest._Chunk.of(dict(zip(forest.CHUNK.names, arrays)), 2)
    return chunk, [entries[i] for i in np.argsort(-lengths, kind="stable")]


def test_forest_weights_are_those_of_the_whole_random_number():
    import numpy as np

    from ledgerloom.operators import forest

    draw = np.random.default_rng(1).integers(0, 2**63, 1 << 20).astype(np.uint64)
    u = forest._mixed(draw + forest._mixed(np.full(1, (42 << 20) + 8, np.uint64)))
    assert (forest._BY_TOP[u >> np.uint64(48)] == forest._UNSURE).any()  # a bound of the distribution is near
    assert (forest._row_weights(draw, 42, 7) == np.searchsorted(forest._WEIGHTS, (u >> np.uint64(11)) * 2.0**-53, side="right")).all()


@pytest.mark.parametrize("cost, few", [(0, 1 << 15), (1e9, 1), (1e9, 1 << 15), (20, 1 << 15)])
def test_forest_sums_are_the_same_by_postings_and_by_entries(monkeypatch, cost, few):
    """Nodes by the postings of their features, by their rows tree after tree or several trees together, or both; against plain loops."""
    from collections import Counter
    from dataclasses import replace

    import numpy as np

    from ledgerloom.operators import forest

    monkeypatch.setattr(forest, "POSTING_COST", cost)
    monkeypatch.setattr(forest, "FEATURE_COST", cost)
    monkeypatch.setattr(forest, "FEW_ROWS", few)
    chunk, entries = _forest_chunk()
    chunk, trees, share = forest._sampled(chunk, 42, 6), 6, 0.4
    assert chunk.nodes.dtype == np.int8  # a byte for each row and tree is kept from level to level
    nodes = np.where(chunk.nodes >= 0, np.random.default_rng(2).choice([0, 0, 0, 0, 1, 2], chunk.nodes.shape), -1).astype(np.int8)
    expected = Counter()
    for tree in range(trees):
        weights = forest._row_weights(chunk.draw, 42, tree) * chunk.weights
        seeds = forest._seed(42, tree, 3, np.arange(3))
        for row, node in enumerate(nodes[tree].tolist()):
            if node < 0:
                continue
            label = int(chunk.labels[tree // 3][row])
            expected[tree, node, -1, label] += weights[row]
            for feature, bin in entries[row].items():
                x, y, drawn = np.array([feature * 0x9E3779B1 & 0xFFFFFFFF], np.uint32), np.empty(1, np.uint32), np.empty(1, bool)
                forest._drawn(seeds[node : node + 1], x, y, share, drawn)
                if drawn[0] and bin:
                    expected[tree, node, feature * forest.BINS + bin, label] += weights[row]
    found = Counter()
    for part in forest._added(replace(chunk, nodes=nodes), 3, 42, 3, [3, 3], share):
        for *key, weight in zip(*(column.tolist() for column in part)):
            assert tuple(key) not in found
            found[tuple(key)] = weight
    assert len(found) > 100 and found == expected


@pytest.mark.parametrize("cost", [0, 1e9])
def test_forest_rows_step_and_are_scored_the_same_by_postings_and_by_entries(monkeypatch, cost):
    from dataclasses import replace

    import numpy as np

    from ledgerloom.operators import forest

    monkeypatch.setattr(forest, "STEP_COST", cost)
    monkeypatch.setattr(forest, "PASS_COST", 1e9)
    chunk, entries = _forest_chunk()
    random, n = np.random.default_rng(3), len(entries)
    expected = np.zeros((n, 3))
    levels, chunk = [], replace(chunk, nodes=np.zeros((4, n), np.int8))
    at, leaves = chunk.nodes.astype(int), {}
    for level in range(9):  # so many nodes that they need two bytes
        splits = []
        for tree in range(4):
            count = 1 if level == 0 else 2 * int((levels[-1][tree][0] >= 0).sum())
            feature = np.where((random.random(count) < 0.9) & (level < 8), random.integers(0, 60, count), -1).astype(np.int32)
            left = np.where(feature >= 0, 2 * (np.cumsum(feature >= 0) - 1), -1).astype(np.int32)
            splits.append((feature, random.integers(1, 4, count).astype(np.int32), left, random.random((count, 3)) + 0.1))
        levels.append(splits)
        moved = forest._moved(chunk, [s[:3] for s in splits])
        for tree, (feature, lowest, left, shares) in enumerate(splits):
            for row in range(n):
                node = at[tree][row]
                if node >= 0 and left[node] < 0:
                    leaves[tree, row] = shares[node]
                at[tree][row] = -1 if node < 0 or left[node] < 0 else left[node] + (entries[row].get(int(feature[node]), 0) >= lowest[node])
        assert (moved.nodes == at).all()
        chunk = moved
    assert max(len(s[0]) for s in levels[-1]) > 128
    for tree in range(4):
        expected += [leaves[tree, row] for row in range(n)]
    rows, features, bins = (np.array(x) for x in zip(*[(r, f, b) for r, e in enumerate(entries) for f, b in e.items() if b]))
    postings = forest._Postings.of(rows, (features * forest.BINS + bins).astype(np.uint32))
    asked, look = [], forest._laid_out(rows, features, bins.astype(np.uint8), n)
    paths = forest._Paths.of(forest._joined(levels, range(4)))
    found = forest._probabilities(paths, postings, n, lambda *a: asked.append(len(a[0])) or look(*a))
    assert np.array_equal(found, expected / expected.sum(axis=1, keepdims=True)) and bool(asked) == (cost == 0)


def test_forest_scores_rows_without_entries(spark):
    import numpy as np
    from pyspark.ml.linalg import Vectors

    from ledgerloom.operators import forest

    trees = forest.Trees(np.array([0]), *(np.array(x, np.int32) for x in ([7, -1, -1], [1, 0, 0], [1, -1, -1])), np.array([[0, 0], [1, 3], [3, 1]], float))
    frame = spark.createDataFrame([(0, Vectors.sparse(9, {})), (1, Vectors.sparse(9, {7: 2.0})), (2, Vectors.dense([1.0] * 9)), (3, Vectors.sparse(9, {1: 5.0}))], ["id", "features"])
    scored = forest.ForestModel(np.array([7 << 32 | 1]), {"a_index": trees}).transform(frame).select("id", "a_probability", "a_prediction")
    assert sorted(map(tuple, scored.collect())) == [(0, [0.25, 0.75], 1.0), (1, [0.75, 0.25], 0.0), (2, [0.75, 0.25], 0.0), (3, [0.25, 0.75], 1.0)]
