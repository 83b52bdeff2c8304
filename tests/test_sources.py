import csv
import hashlib
import io
import json
import os
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from conftest import SHOP, at
from parcelmart.operators.mart import bi_export, build_mart
from parcelmart.schemas import EXPORT_COLUMNS, SOURCE_SCHEMAS
from parcelmart.sources import files, readers, sinks, staging


def _text(*names):
    return StructType([StructField(n, StringType()) for n in names])


def _write_sources(directory):
    for name, schema in SOURCE_SCHEMAS.items():
        with open(f"{directory}/{name}.csv", "w") as out:
            out.write(",".join(schema.names) + "\n")
            for row in SHOP[name]:
                out.write(",".join("" if v is None else str(v) for v in row) + "\n")


def test_mart_from_csv_files(spark, tmp_path):
    _write_sources(tmp_path)
    tables = readers.read_tables(spark, str(tmp_path), SOURCE_SCHEMAS)
    assert {r.table_name: r.n for r in readers.raw_counts(tables).collect()}["orders"] == 6
    row = build_mart(tables).filter("order_id = 'basket'").first()
    assert row.on_time is True and row.post_delivery_score == 4


def test_missing_files_are_named(spark, tmp_path):
    _write_sources(tmp_path)
    with pytest.raises(FileNotFoundError, match="nowhere.csv"):
        readers.read_tables(spark, str(tmp_path), SOURCE_SCHEMAS, filenames={"sellers": "nowhere.csv"})


def test_quoted_line_breaks_and_quotes(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,text\n1,"two\nlines"\n2,"a ""quoted"" word, and comma"\n')
    got = [tuple(r) for r in readers.scan_csv(spark, str(tmp_path / "t.csv"), multi_line=True).orderBy("id").collect()]
    assert got == [(1, "two\nlines"), (2, 'a "quoted" word, and comma')]
    sinks.write(readers.scan_csv(spark, str(tmp_path / "t.csv"), multi_line=True), str(tmp_path / "copy"), "csv")
    assert sorted(tuple(r) for r in readers.scan_csv(spark, str(tmp_path / "copy"), multi_line=True).collect()) == got


def test_columns_are_matched_by_header_name(spark, tmp_path):
    (tmp_path / "c.csv").write_text("customer_city,customer_state,customer_id\nx,SP,1\n")
    got = readers.scan_csv(spark, str(tmp_path / "c.csv"), SOURCE_SCHEMAS["customers"])
    assert got.first().asDict() == {"customer_city": "x", "customer_state": "SP", "customer_id": "1"}
    with pytest.raises(ValueError, match="seller_id"):
        readers.scan_csv(spark, str(tmp_path / "c.csv"), SOURCE_SCHEMAS["sellers"])


def test_unreadable_values_become_null(spark, tmp_path):
    (tmp_path / "r.csv").write_text(
        "review_id,order_id,review_score,review_creation_date,review_answer_timestamp\n"
        "r1,o1,5,2018-01-02,2018-01-03 04:05:06\nr2,o2,five,2018-01-02,tomorrow\n"
    )
    rows = readers.scan_csv(spark, str(tmp_path / "r.csv"), SOURCE_SCHEMAS["reviews"]).orderBy("review_id").collect()
    assert tuple(rows[0]) == ("r1", "o1", 5, datetime(2018, 1, 2), datetime(2018, 1, 3, 4, 5, 6))
    assert tuple(rows[1]) == ("r2", "o2", None, datetime(2018, 1, 2), None)


def test_unreadable_timestamps_become_null(spark, tmp_path):
    (tmp_path / "t.csv").write_text("order_id,order_approved_at,shipped_date,other\n1,2018-01-02 03:04:05,2018-01-01,2018-01-01\n2,soon,,x\n")
    df = readers.scan_csv(spark, str(tmp_path / "t.csv"), _text("order_id", "order_approved_at", "shipped_date", "other"))
    got = readers.coerce_timestamps(df)
    assert dict(got.dtypes)["order_approved_at"] == dict(got.dtypes)["shipped_date"] == "timestamp_ntz"
    assert dict(got.dtypes)["other"] == "string"
    assert [tuple(r) for r in got.orderBy("order_id").collect()] == [
        ("1", datetime(2018, 1, 2, 3, 4, 5), datetime(2018, 1, 1), "2018-01-01"),
        ("2", None, None, "x"),
    ]


@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin"])
def test_explicit_format_is_zone_free(spark, zone):
    df = spark.createDataFrame([("28/03/2021 02:30",), ("2021-03-28",), (None,)], "seen_date string")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        got = [r[0] for r in readers.coerce_timestamps(df, fmt="dd/MM/yyyy HH:mm").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == [datetime(2021, 3, 28, 2, 30), None, None]


def test_register_replaces_views(spark, shop):
    assert "raw_orders" in readers.register(shop)
    readers.register({**shop, "orders": shop["orders"].limit(1)})
    assert spark.table("raw_orders").count() == 1


def test_manifest(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"abc")
    (tmp_path / "b.txt").write_bytes(b"")
    got = {r.file: (r.bytes, r.sha256) for r in readers.source_manifest(spark, str(tmp_path), "*.csv").collect()}
    assert got == {"a.csv": (3, hashlib.sha256(b"abc").hexdigest())}


def test_manifest_of_a_file_above_two_gigabytes(spark, tmp_path):
    size = (2 << 30) + 5
    with open(tmp_path / "big.bin", "wb") as file:
        file.seek(size - 1)
        file.write(b"x")
    digest = hashlib.sha256()
    for _ in range(2048):
        digest.update(bytes(1 << 20))
    digest.update(bytes(4) + b"x")
    assert [tuple(r) for r in readers.source_manifest(spark, str(tmp_path)).collect()] == [("big.bin", size, digest.hexdigest())]


def test_headers_of_many_files_take_one_job(spark, tmp_path):
    from pyspark.sql.types import StructType

    for i in range(300):
        (tmp_path / f"f{i}.csv").write_text(f"a,b\n{i},x\n" if i % 2 else f'b,"a"\n"two\nlines",{i}\n')
    (tmp_path / "empty.csv").write_text("")
    context = spark.sparkContext
    context.setJobGroup("headers", "headers")
    try:
        reader = spark.read.options(**readers.CSV_OPTIONS)
        groups = readers._by_header(spark, reader, str(tmp_path), StructType.fromDDL("a int, b string"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert {h: len(f) for h, f in groups.items()} == {("a", "b"): 150, ("b", "a"): 150}
    assert len(context.statusTracker().getJobIdsForGroup("headers")) <= 2  # Spark lists many files by a job of its own
    got = readers.scan_csv(spark, str(tmp_path), StructType.fromDDL("a int, b string"), multi_line=True)
    assert sorted((r.a, r.b) for r in got.collect()) == [(i, "x" if i % 2 else "two\nlines") for i in range(300)]


@pytest.mark.parametrize("size", [1, 7, 64, 1000, 1 << 20])
def test_one_file_with_quoted_line_breaks_is_read_by_many_tasks(spark, tmp_path, size):
    rnd = random.Random(size)
    fields = ["plain", "", 'a "quote"', "two\nlines", "\n\n", '"', "é\r\nü", ",", "long " * 40]
    rows = [[str(i), rnd.choice(fields), rnd.choice(fields)] for i in range(120 if size > 1 else 12)]
    with open(tmp_path / "t.csv", "w", newline="") as file:
        end = "\r\n" if size in (7, 1000) else "\n"
        writer = csv.writer(file, lineterminator=end)
        writer.writerows([["id", "x", "y\nz"], *rows])
        if size % 2:
            file.write('\n\n999,"no line end","q"')
            rows.append(["999", "no line end", "q"])
    records = files.quoted_records(files.listing(spark, str(tmp_path)), size)
    if 1 < size < 1000:
        assert records.select(F.spark_partition_id()).distinct().count() > 3
    got = [next(csv.reader([r.value.replace("\r\n", "\n")] if "\n" not in r.value else io.StringIO(r.value, newline=""))) for r in records.collect()]
    assert sorted(got) == sorted(rows)
    if end != "\n":
        return  # Spark's own reader of whole files leaves the carriage returns in the last column
    plain = spark.read.options(**readers.CSV_OPTIONS).option("multiLine", True).schema("id int, x string, `y\nz` string").csv(str(tmp_path))
    split = readers.scan_csv(spark, str(tmp_path), plain.schema, multi_line=True)
    assert sorted(map(tuple, split.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_unread_values_are_counted_by_column(spark, tmp_path):
    from pyspark.sql.types import StructType

    (tmp_path / "a.csv").write_text('id,n,t,x\n1,5,2018-01-01 00:00:00,1.5\n2,five,soon,\n3,,2018-01-02 00:00:00,x\n4,7.5,"a ""b""",2\n')
    (tmp_path / "b.csv").write_text("n,id,x,t,other\nmany,5,1,,free\n6,6,1,2018-01-02 00:00:00,\n")
    schema = StructType.fromDDL("id int, n int, t timestamp_ntz, x double")
    for multi_line in (False, True):
        df = readers.scan_csv(spark, str(tmp_path), schema, multi_line=multi_line, unread="_unread")
        assert {r.column: r.n for r in readers.unread_counts(df).collect()} == {"n": 3, "t": 2, "x": 1}
        assert {r.id: r._unread for r in df.collect()} == {1: None, 2: ["n", "t"], 3: ["x"], 4: ["n", "t"], 5: ["n"], 6: None}


def test_a_run_that_ends_early_leaves_whole_months(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "months")
    months = [datetime(2018, m, 1).date() for m in (1, 2, 3)]
    frame = lambda n: spark.createDataFrame([(n + i, m) for i, m in enumerate(months)], "id int, purchase_month date")
    now = lambda: sorted((r.purchase_ym, r.id) for r in readers.scan_parquet(spark, path).collect())
    sinks.write_by_month(frame(0), path)
    old = [("2018-01", 0), ("2018-02", 1), ("2018-03", 2)]
    assert now() == old
    broken = frame(10).withColumn("id", F.when(F.col("id") == 12, F.raise_error(F.lit("stop")).cast("int")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="stop"):
        sinks.write_by_month(broken, path)
    assert now() == old
    swaps, swap = [], sinks._swap

    def one_only(fs, a, b):
        if swaps:
            raise RuntimeError("lost")
        swaps.append(a)
        swap(fs, a, b)

    monkeypatch.setattr(sinks, "_swap", one_only)
    with pytest.raises(RuntimeError, match="lost"):
        sinks.write_by_month(frame(20), path)
    between = now()
    assert all(row in [*old, ("2018-01", 20), ("2018-02", 21), ("2018-03", 22)] for row in between) and len(between) == 3
    monkeypatch.setattr(sinks, "_swap", swap)
    assert len(sinks.finish_partitions(spark, path)) == 2
    assert now() == [("2018-01", 20), ("2018-02", 21), ("2018-03", 22)]
    assert sinks.finish_partitions(spark, path) == [] and not [p for p in os.listdir(path) if p.startswith("_new")]


def test_month_partitions_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "months")
    df = spark.createDataFrame(
        [(1, datetime(2018, 1, 1).date()), (2, datetime(2018, 2, 1).date()), (3, None)], "id int, purchase_month date"
    )
    sinks.write_by_month(df, path)
    sinks.write_by_month(df.filter("id = 2").withColumn("id", F.lit(20)), path)
    assert sorted((r.id, r.purchase_ym) for r in readers.scan_parquet(spark, path).collect()) == [(1, "2018-01"), (20, "2018-02")]


def test_json_has_no_nan(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), (float("inf"), 2.5))], "n int, x double, s struct<a: double, b: double>")
    sinks.write_json(df, str(tmp_path / "j"))
    text = "".join(p.read_text() for p in (tmp_path / "j").glob("part-*.json"))
    assert json.loads(text) == {"n": 1, "x": None, "s": {"a": None, "b": 2.5}}
    assert readers.scan_json(spark, str(tmp_path / "j"), df.schema).first().s.b == 2.5


def test_export_columns(shop):
    export = bi_export(build_mart(shop))
    assert export.columns == EXPORT_COLUMNS and "customer_id" not in export.columns
    assert export.count() == 4


def test_staging_uses_the_configured_folder(spark, shop):
    root = spark.conf.get("spark.checkpoint.dir")
    assert staging.checkpoint_root(spark) == root
    staged = staging.stage(shop["orders"], "orders")
    assert staged.inputFiles()[0].startswith(f"file://{os.path.realpath(root)}")
    assert sorted(map(tuple, staged.collect())) == sorted(map(tuple, shop["orders"].collect()))
    assert at("2023-03-10 18:20") == staged.first().order_purchase_timestamp


def test_temporary_tables_go_and_others_stay(spark, shop):
    kept = staging.stage(shop["sellers"], "kept")
    with staging.temporary(spark) as stage:
        gone = stage(shop["sellers"], "gone").inputFiles()[0].removeprefix("file://")
        assert os.path.exists(gone)
    assert not os.path.exists(gone) and kept.count() == 2


def test_files_with_other_column_orders_are_read_by_name(spark, tmp_path):
    from pyspark.sql.types import StructType

    (tmp_path / "one.csv").write_text("a,b\n1,x\n2,y\n")
    (tmp_path / "two.csv").write_text("b,c,a\nz,extra,3\n")
    got = readers.scan_csv(spark, str(tmp_path), StructType.fromDDL("a int, b string"))
    assert sorted((r.a, r.b, r.c) for r in got.collect()) == [(1, "x", None), (2, "y", None), (3, "z", "extra")]


def test_partition_names_keep_their_type(spark, tmp_path):
    df = spark.createDataFrame([("01", 1), ("02", 2)], "state string, n int")
    sinks.write(df, str(tmp_path / "p"), "parquet", ["state"])
    assert sorted(r.state for r in readers.scan_parquet(spark, str(tmp_path / "p"), df.schema).collect()) == ["01", "02"]
