import json

import pytest
from pyspark.sql import functions as F

from driftloom.functions import tables
from driftloom.sources import catalog, state


def test_folder_sizes_and_tree(spark):
    files = [("a/b/c.txt", 3), ("a/b/d.txt", None), ("a/e", 5), ("f", 7), ("a/b", 1), (None, 9), ("a/x.zarr/0/0", 11), ("a/x.zarr/1", 2), ("a/e", 5)]
    df = spark.createDataFrame([(*f, "n") for f in files], "path string, length long, folder string")
    assert {(r["folder"], r["bytes"], r["files"]) for r in catalog.folder_sizes(df).collect()} == {("a", 27, 7), ("a/b", 3, 2), ("a/x.zarr", 13, 2), ("a/x.zarr/0", 11, 1)}
    got = sorted((r["path"], r["parent"], r["depth"], r["is_folder"], r["bytes"], r["files"], r["more"]) for r in catalog.folder_tree(df, depth=2, items=2, stop=r"\.zarr$").collect())
    assert got == [("a", None, 0, True, 27, 7, 0), ("a/b", "a", 1, True, 4, 3, 1), ("a/b/c.txt", "a/b", 2, False, 3, 1, 0), ("a/b/d.txt", "a/b", 2, False, 0, 1, 0), ("a/e", "a", 1, False, 10, 2, 1), ("f", None, 0, False, 7, 1, 0)]
    stopped = {r["path"] for r in catalog.folder_tree(df, depth=3, items=9, stop=r"\.zarr$").collect()}
    assert "a/x.zarr" in stopped and "a/x.zarr/1" not in stopped
    assert catalog.folder_tree(df.limit(0)).count() == 0 == catalog.folder_sizes(df.limit(0)).count()


def test_metadata_walk(spark):
    v3 = lambda **more: json.dumps({"zarr_format": 3} | more)
    files = [
        ("m/zarr.json", v3(node_type="group", attributes={"long": "y" * 700})), ("m/zarr.txt", "no"),
        ("m/raw/zarr.json", v3(node_type="array", shape=[2, 3], data_type="uint16")), ("m/raw/.zarray", json.dumps({"shape": [9]})),
        ("m/old/.zarray", json.dumps({"shape": [4], "dtype": "<u2", "chunks": [1]})), ("m/old/.zattrs", json.dumps({"a": 1})),
        ("m/none/deep/zarr.json", v3()),  # its parent has no metadata, so it is a root of its own
        ("m/bad/zarr.json", "{"), ("m/raw/a/zarr.json", v3()), ("m/raw/a/b/zarr.json", v3()), (None, "x"), ("zarr.json", None),
    ]
    df = spark.createDataFrame(files, "path string, content string")
    got = {r["folder"]: r for r in catalog.walk_metadata(df, spark.createDataFrame([("m",)], "folder string"), depth=2).collect()}
    assert {k: r["depth"] for k, r in got.items()} == {"m": 0, "m/raw": 1, "m/old": 1, "m/bad": 1, "m/raw/a": 2}
    assert got["m"]["attributes"].endswith("...") and len(got["m"]["attributes"]) == 603 and got["m"]["shape"] is None
    assert [got["m/raw"][c] for c in ("kind", "version", "shape", "dtype", "chunks", "attributes")] == ["array", 3, "[2,3]", "uint16", None, None]
    assert [got["m/old"][c] for c in ("kind", "version", "shape", "dtype", "chunks", "attributes")] == ["array", 2, "[4]", "<u2", "[1]", '{"a":1}']
    assert (got["m/bad"]["kind"], got["m/bad"]["attributes"]) == ("group", None)
    roots = {r["root"] for r in catalog.walk_metadata(df).collect()}
    assert roots == {"m/none/deep", ""}  # '' has a zarr.json, and m lies in it


def test_store_passes_over_versions_that_are_not_complete(spark, tmp_path):
    store = str(tmp_path / "store")
    assert state.load_state(spark, store) is None
    state.save_state(spark.range(3), store, 1)
    state.save_state(spark.range(5), store, 10)
    assert state.load_state(spark, store).count() == 5
    (tmp_path / "store" / "version=10" / "_SUCCESS").unlink()
    (tmp_path / "store" / "version=x").mkdir()
    assert state.latest_version(spark, store) == 1 and state.load_state(spark, store).count() == 3
    with pytest.raises(Exception, match="exist"):
        state.save_state(spark.range(1), store, 1)


def test_keys_are_renamed_in_order(spark):
    df = spark.sql("SELECT map('a.conv1.w', 1, 'a.n1.b', 2) AS m")
    assert df.select(state.renamed_keys(F.col("m"), [(".conv1.", ".net.0."), (".n1.", ".net.1."), (".net.", ".x.")]).alias("m")).first()["m"] == {"a.x.0.w": 1, "a.x.1.b": 2}


def test_functions_in_sql(spark):
    tables.register(spark)
    rows = spark.sql("SELECT * FROM VALUES (1, 0.0D, 3.0D, 2), (2, NULL, 3.0D, 2), (3, 0.0D, 1.0D, 0), (4, 1.0D, 2.0D, NULL) AS g(i, a, b, gap), LATERAL interpolate_gap(a, a, a, b, b, b, gap)").collect()
    assert sorted((r["i"], r["k"], r["z"], r["x"]) for r in rows) == [(1, 1, 1.0, 1.0), (1, 2, 2.0, 2.0)]
    rows = spark.sql("SELECT * FROM VALUES ('a/b/c'), ('a'), (NULL), ('') AS f(path), LATERAL ancestors(path)").collect()
    assert sorted((r["depth"], r["folder"]) for r in rows) == [(0, "a"), (1, "a/b")]
    assert [r[0] for r in spark.sql("SELECT half_even(v) FROM VALUES (0.5D), (1.5D), (-0.5D), (2.4D), (NULL) AS t(v)").collect()] == [0, 2, 0, 2, None]


def test_gap_points_are_those_of_the_table_function_and_need_no_python(spark):
    tables.register(spark)
    gaps = "VALUES (1, 0.0D, 3.0D, 2), (2, NULL, 3.0D, 2), (3, 0.0D, 1.0D, 0), (4, 1.0D, 2.0D, NULL), (5, -1.5D, 0.1D, 1) AS g(i, a, b, gap)"
    listed = spark.sql(f"SELECT i, p.* FROM (SELECT *, gap_points(a, a, a, b, b, b, gap) AS points FROM {gaps}) LATERAL VIEW inline(points) p AS k, z, y, x")
    by_row = spark.sql(f"SELECT i, p.* FROM {gaps}, LATERAL interpolate_gap(a, a, a, b, b, b, gap) AS p")
    assert sorted(map(tuple, listed.collect())) == sorted(map(tuple, by_row.collect())) and listed.count() == 3
    assert "Python" not in listed._jdf.queryExecution().toString()
