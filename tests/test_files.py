"""CSV columns by name, quarantined lines, replaced partitions, and pivots over the values found."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forecastops.operators import aggregates as agg
from forecastops.sources import readers, sinks

SCHEMA = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.DoubleType()), T.StructField("c d", T.StringType())])


def write(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def test_columns_are_found_by_header_name(spark, tmp_path):
    one = write(tmp_path, "1.csv", " b ,a, c d,extra\n2.5,1,x,9\nNaN,bad,,9\n")
    two = write(tmp_path, "2.csv", "c d,b,a\ny,3.5,2\n")
    got = readers.read_csv_by_name(spark, [one, two], SCHEMA)
    assert got.dtypes == [("a", "int"), ("b", "double"), ("c d", "string")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 2.5, "x"), (None, None, None), (2, 3.5, "y")], key=str)
    assert readers.read_csv_by_name(spark, [], SCHEMA).count() == 0


def test_missing_and_repeated_names(spark, tmp_path):
    short = write(tmp_path, "3.csv", "a,b\n1,2\n")
    with pytest.raises(ValueError, match="c d.*missing"):
        readers.read_csv_by_name(spark, [short], SCHEMA)
    assert [tuple(r) for r in readers.read_csv_by_name(spark, [short], SCHEMA, fill_missing=True).collect()] == [(1, 2.0, None)]
    with pytest.raises(ValueError, match="occur twice"):
        readers.read_csv_by_name(spark, [write(tmp_path, "4.csv", "a, a,b,c d\n1,2,3,4\n")], SCHEMA)


def test_bad_lines_are_kept_beside(spark, tmp_path):
    path = write(tmp_path, "5.csv", '1,x,"a,b"\n2,y\n3,z,c,d\n\n4,"q\\"r,s",t\n,,\n')
    good, bad = readers.read_csv_quarantine(spark, path, ["k", "u", "v"])
    assert sorted(map(tuple, good.collect()), key=str) == sorted([("1", "x", "a,b"), ("4", 'q"r,s', "t"), (None, None, None)], key=str)
    assert sorted((r.n_cells, r.line, r.file.endswith("5.csv")) for r in bad.collect()) == [(2, "2,y", True), (4, "3,z,c,d", True)]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_a_rerun_replaces_its_own_partitions(spark, tmp_path, fmt):
    rows = spark.createDataFrame([(1, 10, "x"), (2, 20, "y"), (2, 21, "z")], "v int, year int, w string")
    path = str(tmp_path / "table")
    for _ in range(2):
        sinks.replace_partitions(rows, path, ["year"], fmt)
    sinks.replace_partitions(spark.createDataFrame([(7, 20, "n"), (8, 30, "m")], "v int, year int, w string"), path, ["year"], fmt)
    got = spark.read.option("header", True).format(fmt).load(path).select(F.col("v").cast("int"), F.col("year").cast("int"), "w")
    assert sorted(map(tuple, got.collect())) == [(1, 10, "x"), (2, 21, "z"), (7, 20, "n"), (8, 30, "m")]


def test_pivot_takes_the_values_found(spark):
    df = spark.createDataFrame([("p", 2001, 1), ("p", 2003, 2), ("q", 2003, 3), ("q", None, 9), ("p", 2003, 4)], "k string, y int, v int")
    wide = agg.pivot_found(df, ["k"], "y", "v", "y")
    assert wide.columns == ["k", "y2001", "y2003"] and sorted(map(tuple, wide.collect())) == [("p", 1, 6), ("q", None, 3)]
    long = agg.pivot_found(df, ["k"], "y", "v", "y", limit=1)
    assert sorted(map(tuple, long.collect()), key=str) == sorted([("p", 2001, 1), ("p", 2003, 6), ("q", 2003, 3), ("q", None, 9)], key=str)
