"""Sources and sinks on small files, reports that count on the way, and statuses."""

import threading

import pytest
from pyspark.sql import functions as F

from cohortry.functions import scalar as S
from cohortry.operators import clean as C
from cohortry.operators import reports as R
from cohortry.sources import tables as T
from cohortry.sources.shared import Scratch, materialize


def values(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


SCHEMA = "id string, flow double, rt double"


@pytest.fixture
def sources(tmp_path):
    for name, text in {
        "0001": "id\tflow\trt\n1\t0.4\t9.5\n2\tNaN\t\n",
        "0002": "rt\tid\tflow\n9.5\t1\t0.4\n",
        "0003": "﻿id\trt\tcomment\trt\n007\t1.5\ta, b\t99\n",
        "00 04%": "id\n5\n",
        "0005": "id\tflow\trt\n",
        "0006": "",
    }.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "data.tsv").write_text(text)
    return f"file://{tmp_path}/*/*.tsv"


def test_sources_by_name(spark, sources):
    got = values(T.read_sources(spark, sources, SCHEMA), "dir_id", "id")
    assert got == [("00 04%", "5", None, None), ("0001", "1", 0.4, 9.5), ("0001", "2", None, None), ("0002", "1", 0.4, 9.5), ("0003", "007", None, 1.5)]
    report = values(T.column_report(spark, sources, SCHEMA), "source", "column")
    assert report == [("00 04%", "flow", "missing"), ("00 04%", "rt", "missing"), ("0003", "comment", "unknown"), ("0003", "flow", "missing"), ("0003", "rt.1", "unknown")]


def test_wanted_columns_alone_are_read(spark, sources):
    plan = T.read_by_name(spark, sources, "id string")._jdf.queryExecution().executedPlan().toString()
    reads = [x for x in plan.splitlines() if "FileScan csv" in x]
    assert reads and all("ReadSchema: struct<_0:string>" in x or "ReadSchema: struct<_1:string>" in x for x in reads)


def test_no_source_has_a_line(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.tsv").write_text("")
    assert T.read_sources(spark, f"file://{tmp_path}/*/*.tsv", SCHEMA).collect() == []


def test_too_many_headers(spark, sources, monkeypatch):
    monkeypatch.setattr(T, "MOST_HEADERS", 2)
    with pytest.raises(ValueError, match="different headers"):
        T.read_sources(spark, sources, SCHEMA)


def test_build_for_the_inputs_of_now(spark, tmp_path):
    source, path, calls = f"file://{tmp_path}/in", f"file://{tmp_path}/out", []
    spark.range(3).write.parquet(source)

    def build():
        calls.append(1)
        return spark.read.parquet(source)

    first = T.build_if_missing(spark, path, build, [source])
    assert first.count() == T.build_if_missing(spark, path, build, [source]).count() == 3 and len(calls) == 1
    spark.range(2).write.mode("append").parquet(source)
    assert T.build_if_missing(spark, path, build, [source]).count() == 5 and len(calls) == 2
    assert first.count() == 3  # a reader of the old build keeps it


def test_broken_build_is_never_seen(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    broken = lambda: spark.range(5).select(F.raise_error(F.lit("lost")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        T.build_if_missing(spark, path, broken)
    assert T.build_if_missing(spark, path, lambda: spark.range(4)).count() == 4


def test_two_builders_at_once(spark, tmp_path):
    path, inside, got = f"file://{tmp_path}/out", threading.Barrier(2), []

    def build(n):
        inside.wait()  # both have seen that nothing is there
        return spark.range(n)

    threads = [threading.Thread(target=lambda n=n: got.append(T.build_if_missing(spark, path, lambda: build(n)).count())) for n in (4, 6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(got) == 2 and got[0] == got[1] in (4, 6)
    assert len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("build-")]) == 1


def test_scratch_blocks_of_two_threads(spark):
    entered, left = threading.Barrier(2), threading.Barrier(2)
    kept = []

    def work(n):
        with Scratch(spark):
            entered.wait()
            kept.append((n, materialize(spark.range(n), "own")))
            left.wait()
            if n == 3:
                left.wait()
                assert kept and dict(kept)[3].count() == 3  # the other block has ended
        if n == 2:
            left.wait()

    failed = []

    def safe(n):
        try:
            work(n)
        except BaseException as e:  # noqa: BLE001
            failed.append(e)
            left.abort()

    threads = [threading.Thread(target=safe, args=(n,)) for n in (2, 3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and not Scratch.blocks()


def test_gradient_status(spark):
    rows = spark.createDataFrame([("a", 0.0, 1.0), ("a", 1.0, 1.0), ("b", None, 1.0), ("b", 1.0, 1.0), ("c", 0.0, None)], "k string, t double, f double")
    expected = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "k string")
    files = expected.filter("k <> 'e'")
    assert values(C.gradient_status(expected, rows, "k", "t", "f", files), "k") == [
        ("a", "Gradient data ok", 2), ("b", "Empty data table", 0), ("c", "Need flow rate imputation", 1), ("d", "Empty data table", 0), ("e", "Gradient.tsv not found", 0),
    ]
    counts = spark.createDataFrame([("a", 5), ("b", 7), ("e", 1)], "k string, n bigint")
    left = R.unusable_sources(counts, C.gradient_status(expected, rows, "k", "t", "f", files), "k", "n", [C.GRADIENT_EMPTY, C.GRADIENT_LOST])
    assert values(left, "source") == [("Total", 8), ("b", 7), ("e", 1)]
    assert values(R.unusable_sources(counts.limit(0), counts.select("k", F.lit("x").alias("status")), "k", "n", []), "source") == [("Total", 0)]


def test_totals_by_method(spark):
    rows = spark.createDataFrame([("RP", "a", 2), ("RP", "b", 3), (None, "c", 4)], "m string, k string, n bigint")
    assert values(R.totals_by_method(rows, "m", "k", "n"), "m", "source") == [(None, "Total", 4), (None, "c", 4), ("RP", "Total", 5), ("RP", "a", 2), ("RP", "b", 3)]


def test_numeric_or_fail(spark):
    good = spark.createDataFrame([("1.5",), (None,), (" 2 ",)], "x string")
    assert [r[0] for r in good.select(S.numeric_or_fail(F.col("x"), "x")).collect()] == [1.5, None, 2.0]
    with pytest.raises(Exception, match="x has a value that is no number: abc"):
        spark.createDataFrame([("1",), ("abc",)], "x string").select(S.numeric_or_fail(F.col("x"), "x")).collect()


def test_flow_counts_on_the_way(spark, tmp_path):
    spark.range(100).write.parquet(f"file://{tmp_path}/t")
    stages = [("odd", lambda x: x.filter("id % 2 = 0")), ("large", lambda x: x.filter("id < 50")), ("none", lambda x: x)]
    out, report = R.flow(spark.read.parquet(f"file://{tmp_path}/t"), stages)
    assert out.count() == 25 and values(report, "position") == [(1, "odd", 50), (2, "large", 25), (3, "none", 0), (4, "total", 75)]
    assert "FileScan" not in report._jdf.queryExecution().executedPlan().toString()  # nothing is read for the report
    out, report = R.flow(spark.read.parquet(f"file://{tmp_path}/t").filter("id < 0"), stages)
    assert out.count() == 0 and {r.dropped for r in report.collect()} == {0}


def test_one_hot_of_too_many_values(spark, monkeypatch):
    monkeypatch.setattr(C, "MOST_VALUES", 3)
    with pytest.raises(ValueError, match="over 3 values"):
        C.one_hot(spark.range(4), "id")
