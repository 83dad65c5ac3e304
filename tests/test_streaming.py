"""Streaming forms: repeated input does not change the outcome."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from priceloom.operators.review import confirmed_drafts
from priceloom.streaming import jobs as J

from test_books import CHANGE, book, change


def test_ingest_is_idempotent(spark, tmp_path):
    table = J.VersionedTable(spark, str(tmp_path / "book"))
    table.write(book(spark, ("h0", "旧", "", "个", "", 1)), 0)
    inbox = tmp_path / "in"
    inbox.mkdir()
    text = "器材名称,规格参数,单位,单价,厂家\n烧杯,100ml,个,5.5,甲\n试管,,支,2,甲\n"
    (inbox / "one.csv").write_text(text, encoding="utf-8")
    for name in (None, "two.csv"):
        if name:
            (inbox / name).write_text(text, encoding="utf-8")
        q = J.stream_ingest(spark, str(inbox), table, str(tmp_path / "cp"))
        assert q.awaitTermination(120)
        assert sorted(r.name for r in table.read().collect()) == ["旧", "烧杯", "试管"]


def test_audit_windows_stream(spark, tmp_path):
    src = str(tmp_path / "ev")
    base = dt.datetime(2024, 1, 1)
    rows = [(base + dt.timedelta(hours=6 * i), "a" if i % 3 else "b") for i in range(12)] + [(base + dt.timedelta(days=9), "z")]
    spark.createDataFrame(rows, "ts timestamp, action string").write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, action string").parquet(src)
    q = (J.audit_windows(stream, "1 day", "1 hour").writeStream.format("memory").queryName("audit_out").outputMode("complete").trigger(availableNow=True).start())
    assert q.awaitTermination(120)
    got = {(r.window_start, r.action): r.events for r in spark.table("audit_out").collect()}
    want = {(r.window_start, r.action): r.events for r in J.audit_windows(spark.read.parquet(src)).collect()}
    assert got == want and sum(got.values()) == 13


def test_drafts_release_after_rejection(spark, tmp_path):
    schema = "draft_id int, line_id int, confirmed_price double, status string, name string, spec string, unit string, manufacturer string, version int"
    table = J.VersionedTable(spark, str(tmp_path / "drafts"))
    table.write(spark.createDataFrame([(0, 9, 1.0, "pending", "x", "", "", "", 0)], schema).withColumn("outcome", F.lit("pending")), 0)
    src = str(tmp_path / "in")
    rows = [(1, 1, 5.0, "approved", "烧杯", "", "个", "", 1), (2, 1, 5.0, "pending", "烧杯", "", "个", "", 1), (3, 2, 5.0, "approved", "烧-杯", "", "个", "", 1),
            (4, 3, 7.0, "rejected", "试管", "", "个", "", 1), (5, 3, 7.0, "pending", "试管", "", "个", "", 1), (6, 4, 1.0, "approved", "旧", "", "个", "", 1)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    q = J.stream_drafts(spark.readStream.schema(schema).parquet(src), table, book(spark, ("h0", "旧", "", "个", "", 1)), str(tmp_path / "cp"))
    assert q.awaitTermination(120)
    got = {r.draft_id: r.outcome for r in table.read().collect()}
    assert got == {0: "pending", 1: "promoted", 2: "repeated", 3: "already_in_book", 4: "rejected", 5: "pending", 6: "already_in_book"}


def test_change_feed(spark, tmp_path):
    table = J.VersionedTable(spark, str(tmp_path / "book"))
    J.starting_book(table, book(spark, ("a", "甲物", "", "个", "", 1), ("b", "乙物", "", "个", "", 2)))
    src = str(tmp_path / "in")
    spark.createDataFrame([change(1, "update", "a", revision=1, price=9.0), change(2, "delete", "b")], CHANGE).coalesce(1).write.parquet(src)
    q = J.stream_changes(spark.readStream.schema(CHANGE).parquet(src), table, str(tmp_path / "res"), str(tmp_path / "cp"))
    assert q.awaitTermination(180)
    assert [(r.id, r.price, r.revision) for r in table.read().collect()] == [("a", 9.0, 2)]
    assert spark.read.parquet(str(tmp_path / "res" / "*")).filter("status = 'ok'").count() == 2


def test_drafts_of_confirmed_lines(spark):
    lines = spark.createDataFrame(
        [(n, "j", f"thing {n}", "line spec", "", "line brand", "", "pc", "L1", n != 6) for n in range(1, 8)],
        "line_id int, job_id string, name string, spec string, model string, brand string, manufacturer string, unit string, product_code string, confirmed boolean")
    options = spark.createDataFrame([
        (1, 10, 1, "h1", 9.0, False, None, None), (1, 11, 2, "h1", 8.0, True, "hand", "hand"), (1, 12, 3, None, 7.0, True, None, None),
        (2, 20, 1, None, 5.0, True, "", "hand"), (3, 30, 1, "h1", 0.0, True, None, None), (3, 31, 2, "h1", 4.0, True, None, None),
        (4, 40, 1, "h1", 4.0, False, None, None), (5, 50, 1, "gone", 3.0, True, None, None), (6, 60, 1, "h1", 2.0, True, None, None),
        (1, 9, 2, None, 6.0, False, None, None)],
        "line_id int, option_id int, rank int, history_id string, final_price double, selected boolean, manual_spec string, manual_manufacturer string")
    history = spark.createDataFrame([("h1", "", "m1", "b1", "maker", "box", "H1")],
                                    "id string, spec string, model string, brand string, manufacturer string, unit string, product_code string")
    got = {r.line_id: r for r in confirmed_drafts(lines, options, history).collect()}
    # 3: the primary has no price; 4: nothing selected; 6: not confirmed; 7: no options.
    assert sorted(got) == [1, 2, 5]
    assert tuple(got[1])[2:11] == ("thing 1", "", "m1", "b1", "maker", "box", "H1", 8.0, 9.0)
    assert tuple(got[2])[2:11] == ("thing 2", "line spec", "", "line brand", "hand", "pc", "L1", 5.0, 5.0)
    assert (got[5].spec, got[5].manufacturer, got[5].confirmed_price, got[5].status) == ("line spec", "", 3.0, "pending")
    assert confirmed_drafts(lines, options.limit(0), history).count() == 0


def test_table_without_versions(spark, tmp_path):
    with pytest.raises(ValueError, match="no complete version"):
        J.VersionedTable(spark, str(tmp_path / "none")).read()
