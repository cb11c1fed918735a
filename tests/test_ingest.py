"""CSV to store, and what must not get through."""

import json

import pytest
from pyspark.sql import functions as F

from basketlens.model import SOURCE_COLUMNS
from basketlens.plans import export, pages
from basketlens.sources import cleaning, raw_csv, store
from basketlens.sources.tables import raw_sessions

LINE = dict(customer_id="7", session_id="1", visit_date="5-3-2024", device_type="0", user_type="1",
            marketing_channel="2", product_id="3", product_category="4", unit_price="12.34", quantity="2.9",
            discount_percent="10", discount_amount="2.47", revenue="22.21", pages_viewed="", time_on_site_sec="x",
            added_to_cart="1", purchased="1", cart_abandoned="0", rating="5", review_text="", review_helpful_votes="1",
            payment_method="1", visit_day="5", visit_month="3", visit_weekday="1", visit_season="1",
            session_duration_bucket=" ", revenue_normalized="0.5", location="9")


def write_csv(path, *rows):
    lines = [",".join(SOURCE_COLUMNS)] + [",".join((LINE | r)[c] for c in SOURCE_COLUMNS) for r in rows]
    path.write_bytes(b"\xef\xbb\xbf" + "\r\n".join(lines).encode() + b"\r\n")
    return str(path)


def test_lenient_cleaning(spark, tmp_path):
    raw = raw_csv.read_raw(spark, write_csv(tmp_path / "a.csv", {}))
    assert raw.columns == [*SOURCE_COLUMNS, raw_csv.BROKEN]
    r = cleaning.accepted(cleaning.parse(raw)).first()
    assert (r.unit_cents, r.quantity, r.gross_cents, r.discount_cents) == (1234, 2, 2468, 247)
    assert (r.pages_viewed, r.time_on_site_sec, r.duration_bucket, r.review_code) == (0, 0, "Unknown", 0)
    assert (str(r.visit_date), r.weekday, r.weekday_name, r.month_name, r.season_name) == (
        "2024-03-05", 1, "Tue", "Mar", "Spring (Mar-May)")
    assert (r.category_label, r.user_type_label, r.location_label) == ("Category 4", "User type 1", "Location 9")
    assert len(r) == 40


def test_rejects_and_missing_ids(spark, tmp_path):
    path = write_csv(tmp_path / "a.csv", {}, {"session_id": "2", "visit_date": "31-02-2024"},
                     {"session_id": "3", "visit_date": "x"}, {"session_id": "4", "location": ""}, {"session_id": ""},
                     {"session_id": "5", "visit_season": "8"})
    parsed = cleaning.parse(raw_csv.read_raw(spark, path))
    assert {(r.session_id, r.reason) for r in cleaning.rejected(parsed).collect()} == {
        (2, "unparseable visit_date"), (3, "unparseable visit_date"), (4, "missing location")}
    clean = cleaning.accepted(parsed)
    assert clean.count() == 3 and clean.filter("session_id IS NULL").isEmpty()
    assert clean.filter("session_id = 5").first().season_name == "Season NA"


def test_header_must_be_complete(spark, tmp_path):
    (tmp_path / "b.csv").write_text("customer_id,visit_date\n1,05-03-2024\n")
    with pytest.raises(ValueError, match="product_category"):
        raw_csv.read_raw(spark, str(tmp_path / "b.csv"))


def test_numbers_out_of_range_are_rejected_with_their_row(spark, tmp_path):
    path = write_csv(tmp_path / "a.csv", {"unit_price": "99999999999999999999"}, {"session_id": "2", "quantity": "9000000000000000000"},
                     {"session_id": "3", "pages_viewed": "99999999999"}, {"session_id": "4", "customer_id": "1e300"},
                     {"session_id": "5", "unit_price": "99999999999999999.00", "quantity": "0"})
    raw = raw_csv.read_raw(spark, path).withColumn("row_no", F.monotonically_increasing_id())
    got = {r.session_id: (r.reason, r.raw) for r in cleaning.rejected(cleaning.parse(raw)).collect()}
    assert {k: v[0] for k, v in got.items()} == {
        1: "out of range unit_price", 2: "out of range gross_value", 3: "out of range pages_viewed", 4: "out of range customer_id",
        5: "out of range unit_price"}
    assert json.loads(got[1][1])["unit_price"] == "99999999999999999999"


def test_files_keep_their_own_header(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write_csv(tmp_path / "in" / "a b.csv", {}, {"session_id": "2", "session_duration_bucket": '"a ""long"" one\nof two lines"'})
    other = [c for c in reversed(SOURCE_COLUMNS) if c != "visit_day"]
    rows = [LINE | {"session_id": "3"}, LINE | {"session_id": "4"}]
    lines = [",".join(other), ",".join(rows[0][c] for c in other), ",".join(rows[1][c] for c in other) + ",surplus", "too,few"]
    (tmp_path / "in" / "c%20d.csv").write_text("\n".join(lines) + "\n")
    export.build_store(spark, str(tmp_path / "in"), str(tmp_path / "store"))
    stored = {r.session_id: r for r in store.stored_sessions(spark, str(tmp_path / "store")).collect()}
    assert set(stored) == {1, 2, 3} and {r.customer_id for r in stored.values()} == {7} and {r.location for r in stored.values()} == {9}
    assert stored[2].duration_bucket == 'a "long" one\nof two lines'
    rejects = store.read_table(spark, str(tmp_path / "store"), "rejects").collect()
    assert {r.reason for r in rejects} == {"malformed row"} and len(rejects) == 2 and any("surplus" in r.raw for r in rejects)
    assert store.read_table(spark, str(tmp_path / "store"), "source_files").count() == 2


def test_no_row_is_lost(spark, tmp_path):
    path = write_csv(tmp_path / "a.csv", {}, {}, {"revenue": "5"}, {"session_id": ""}, {"session_id": ""}, {"session_id": "9", "visit_date": ""})
    here = str(tmp_path / "store")
    export.build_store(spark, path, here)
    stored, rejects = store.stored_sessions(spark, here), store.read_table(spark, here, "rejects")
    assert stored.count() == 3 and stored.select("session_id").distinct().count() == 3
    assert sorted(r.reason for r in rejects.collect()) == ["repeated session_id", "repeated session_id", "unparseable visit_date"]
    meta = {r.key: r.value for r in store.read_table(spark, here, "meta").collect()}
    assert (meta["rows"], meta["repeated_rows"], meta["unparsed_rows"]) == ("3", "2", "1") and meta["built_at"].startswith("20")
    assert export.provenance(spark, here) | {"rows": "3", "files": "1"} == export.provenance(spark, here)


def test_a_failing_load_leaves_the_old_store(spark, tmp_path, monkeypatch):
    here, path = str(tmp_path / "store"), write_csv(tmp_path / "a.csv", {})
    export.build_store(spark, path, here)
    monkeypatch.setattr(export, "metadata", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        export.build_store(spark, write_csv(tmp_path / "b.csv", {}, {"session_id": "2"}), here)
    assert store.stored_sessions(spark, here).count() == 1
    monkeypatch.undo()
    export.build_store(spark, str(tmp_path / "b.csv"), here)
    assert store.stored_sessions(spark, here).count() == 2


def test_build_and_reopen(spark, tmp_path, folder):
    raw = raw_sessions(spark, folder)
    raw.write.option("header", True).option("emptyValue", "").csv(str(tmp_path / "csv"))
    export.build_store(spark, str(tmp_path / "csv"), str(tmp_path / "store"))
    here = str(tmp_path / "store")
    stored = store.stored_sessions(spark, here)
    meta = {r.key: r.value for r in store.read_table(spark, here, "meta").collect()}
    assert int(meta["rows"]) == stored.count() == stored.select("session_id").distinct().count()
    assert int(meta["rows"]) + int(meta["unparsed_rows"]) + int(meta["repeated_rows"]) == raw.count()
    assert len(json.loads(meta["findings"])) >= 5
    assert store.read_table(spark, here, "dq_columns").count() == 29
    assert store.read_table(spark, here, "rejects").count() == int(meta["unparsed_rows"]) + int(meta["repeated_rows"])
    assert store.status(stored).first().ready
    assert pages.conversion(stored).count() > 40


def test_missing_store_is_none_but_other_errors_surface(spark, tmp_path):
    assert store.stored_sessions(spark, str(tmp_path / "nowhere")) is None


def test_export_document(spark, sessions):
    doc = json.loads(export.export(sessions, {"cat": "2", "bucket": "nope"}, {"file": "a.csv"}).first().value)
    assert doc["filters"] == {"cat": "2"} and doc["source"] == {"file": "a.csv"}
    assert [s["segment"] for s in doc["segments"]] == ["High value", "Mid value", "Core value", "Window shoppers"]
    assert sum(s["sessions"] for s in doc["segments"]) == doc["totals"]["sessions"]


def test_json_safe(spark):
    from basketlens.functions.numbers import json_safe
    df = spark.sql("SELECT double('NaN') AS a, double('Infinity') AS b, 1.5D AS c, 'x' AS d")
    assert tuple(json_safe(df).first()) == (None, None, 1.5, "x")
    nested = spark.sql("""SELECT named_struct('a', double('NaN'), 'b', array(1D, double('-Infinity'), NULL), 'c', 7) AS s,
        map('k', array(named_struct('v', float('Infinity'), 'w', 'x')), 'n', NULL) AS m, CAST(NULL AS struct<a: double>) AS n, array(1, 2) AS i""")
    safe = json_safe(nested)
    assert safe.schema.simpleString() == nested.schema.simpleString()
    assert safe.first().asDict(recursive=True) == {"s": {"a": None, "b": [1.0, None, None], "c": 7}, "m": {"k": [{"v": None, "w": "x"}], "n": None}, "n": None, "i": [1, 2]}


def test_invariants(spark, sessions):
    from basketlens.functions.dimensions import DIMENSIONS
    from basketlens.operators import aggregate as A
    total = A.totals(sessions).first()
    assert total.carts == total.purchases + total.abandoned
    for dim in DIMENSIONS:
        rows = A.group(sessions, dim, ["sessions", "revenue"]).collect()
        assert sum(r.sessions for r in rows) == total.sessions
        assert round(sum(r.revenue for r in rows), 2) == round(total.revenue, 2)
    segments = export.segment_table(sessions).collect()
    assert sum(r.customers for r in segments) == total.customers
    assert round(sum(r.customer_share for r in segments), 6) == 100.0
    assert round(sum(r.revenue_share for r in segments), 6) == 100.0
