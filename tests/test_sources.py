from driftloom.sources import frames, sinks

NODES = "dataset int, node_id long, t int, z double, y double, x double"
EDGES = "dataset int, source_id long, target_id long"


def test_sinks(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 7, 0, 2.5, 3.5, 0.0), (0, 3, 1, 0.0, 0.0, 0.0), (0, 4, 2, 0.0, 0.0, 0.0), (0, 5, 2, 0.0, 0.0, 0.0)], NODES)
    edges = spark.createDataFrame([(0, 3, 4), (0, 3, 5)], EDGES)
    rows = [tuple(r) for r in sinks.submission_table(nodes, edges).orderBy("id").collect()]
    assert rows[0] == (0, "0", "node", 3, 1, 0, 0, 0, -1, -1) and rows[3] == (3, "0", "edge", -1, -1, -1, -1, -1, 3, 4)
    assert rows[5] == (5, "1", "node", 7, 0, 2, 4, 0, -1, -1)
    sinks.write_submission(nodes, edges, str(tmp_path / "s"))
    assert spark.read.csv(str(tmp_path / "s"), header=True).count() == 6
    sinks.write_tracks(nodes, edges, str(tmp_path / "t"))
    got = sorted(r["value"] for r in spark.read.text(str(tmp_path / "t") + "/dataset=0").collect())
    assert got == ["1 1 1 0", "2 2 2 1", "3 2 2 1"]
    sinks.write_split(spark.createDataFrame([("b", "train"), ("a", "train"), ("c", "val")], "dataset string, split string"), str(tmp_path / "j"))
    assert {r["split"]: r["datasets"] for r in spark.read.json(str(tmp_path / "j")).collect()} == {"train": ["a", "b"], "val": ["c"]}
    sinks.write_history(spark.createDataFrame([(1, 0.5)], "epoch int, val double"), str(tmp_path / "h"))
    assert spark.read.csv(str(tmp_path / "h"), header=True).first()["val"] == "0.5"


def test_lookup_with_fallback(spark):
    wanted = spark.createDataFrame([("a",), ("c",)], "stem string")
    listing = spark.createDataFrame([("a", "x/a.2"), ("a", "x/a.1"), ("b", "w/b")], "stem string, path string")
    got = {r["stem"]: r["path"] for r in sinks.lookup_with_fallback(wanted, listing, "stem").collect()}
    assert got == {"a": "x/a.1", "c": "w/b"}
    assert {r["path"] for r in sinks.lookup_with_fallback(wanted, listing.limit(0), "stem").collect()} == {None}


def test_graphs_and_frames(spark, tmp_path):
    nodes = spark.createDataFrame([(0, 1, 0, 1.0, 2.0, 3.0)], NODES)
    nodes.write.parquet(str(tmp_path / "n"))
    n, e = frames.read_graph(spark, str(tmp_path / "n"), None)
    assert e.isEmpty() and [tuple(p) for p in frames.points_by_frame(n).first()["points"]] == [(1, 2, 3)]
    frames.write_frames(spark.createDataFrame([("a", t, [1, 1, 2], bytes([t, 0, 0, 0])) for t in range(3)], frames.FRAMES), str(tmp_path / "f"))
    one = frames.read_frames(spark, str(tmp_path / "f")).where("t = 2")
    assert "PartitionFilters: [isnotnull(t" in one._jdf.queryExecution().toString()
    assert [tuple(r) for r in frames.voxels(one).collect()] == [("a", 2, 0, 0, 0, 2.0)]
    assert frames.listing(spark, str(tmp_path / "n"), "*.parquet").count() >= 1


def test_raw_graph_takes_either_path_of_a_property(spark, tmp_path):
    root = str(tmp_path / "g")
    spark.createDataFrame([(0, 7), (1, 8)], "ord long, node_id long").write.parquet(f"{root}/nodes/ids")
    spark.createDataFrame([(0, 1.5), (1, 2.5)], "ord long, value double").write.parquet(f"{root}/nodes/props/z/values")
    spark.createDataFrame([(1, 4)], "ord long, value int").write.parquet(f"{root}/nodes/props/t")
    (tmp_path / "g/nodes/props/broken").mkdir()
    nodes, edges = frames.read_graph_raw(spark, root)
    assert edges is None and nodes.columns == ["node_id", "t", "z"]
    assert sorted(tuple(r) for r in nodes.collect()) == [(7, None, 1.5), (8, 4, 2.5)]
    spark.createDataFrame([(7, 8)], "source_id long, target_id long").write.parquet(f"{root}/edges/ids")
    assert [tuple(r) for r in frames.read_graph_raw(spark, root)[1].collect()] == [(7, 8)]


def test_find_folder(spark):
    files = spark.createDataFrame([("a/x.bin",), ("b/y.pt",), ("b/z.bin",), ("c/best.pt",), (None,)], "path string")
    first = lambda patterns, of=files: [r["folder"] for r in frames.find_folder(of, patterns).collect()]
    assert first([r"best\.pt$", r"\.pt$"]) == ["c"]
    assert first([r"nothing", r"\.pt$"]) == ["b"]
    assert first([r"nothing"]) == ["b"]
    assert first([r"nothing"], files.limit(0)) == []


def test_split_is_read_back(spark, tmp_path):
    rows = [("b", "train"), ("a", "train"), ("c", "val")]
    sinks.write_split(spark.createDataFrame(rows, "dataset string, split string"), str(tmp_path / "j"))
    assert sorted((r["dataset"], r["split"]) for r in sinks.read_split(spark, str(tmp_path / "j")).collect()) == sorted(rows)
