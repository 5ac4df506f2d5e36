import random

from driftloom.config import V2
from driftloom.operators import graph, linking, spatial


def test_tracks_of_close_numbers_need_few_rounds(spark, monkeypatch):
    # 200 tracks of 30 nodes in mixed order, of which a task contracts 300 edges at a time
    steps = [(1000 * u + t, 1000 * u + t + 1) for u in range(200) for t in range(29)]
    random.Random(0).shuffle(steps)
    edges = spark.createDataFrame(steps, "a long, b long").repartition(1)
    monkeypatch.setattr(graph, "CONTRACT", 300)
    calls, star = [], graph._star
    monkeypatch.setattr(graph, "_star", lambda arcs: calls.append(1) or star(arcs))
    rounds, batch = {}, spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 300)
    try:
        for near in (False, True):
            calls.clear()
            found = {r["node"]: r["component"] for r in graph.connected_components(edges, "a", "b", near=near).collect()}
            assert found == {1000 * u + t: 1000 * u for u in range(200) for t in range(30)}
            rounds[near] = len(calls) // 2
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert rounds[True] <= 2 and rounds[True] < rounds[False]


def test_ends_are_numbered_in_their_order(spark):
    ends = spark.createDataFrame([(i % 2, 7919 * i % 501) for i in range(400)], "dataset int, node_id long").repartition(5)
    rows = [(r["dataset"], r["node_id"]) for r in graph._numbered(ends).orderBy("n").collect()]
    assert rows == sorted(set(rows)) and len(rows) == 400


def test_a_forest_connects_what_pairs_connect_with_fewer_rows(spark):
    r = random.Random(3)
    crowd = [(0, t, 1000 * t + i, r.uniform(0, 6), r.uniform(0, 6), r.uniform(0, 90)) for t in range(3) for i in range(150)]
    points = spark.createDataFrame(crowd, "dataset int, t int, det_id long, z double, y double, x double")
    pairs = spatial.frame_candidates(points, 8.0, (1.0, 1.0, 1.0))
    forest = spatial.frame_forest(points, 8.0, (1.0, 1.0, 1.0))
    found = [{x["node"]: x["component"] for x in graph.connected_components(df, "source_id", "target_id").collect()} for df in (pairs, forest)]
    assert found[0] == found[1] and forest.count() < pairs.count() / 3


def test_two_passes_shuffle_no_pairs(spark):
    crowd = [(0, t, 1000 * t + i, 0.0, 0.1 * i, 0.07 * i * (i % 3)) for t in range(2) for i in range(40)]
    points = spark.createDataFrame(crowd, "dataset int, t int, det_id long, z double, y double, x double")
    links = linking.twopass_link(points, V2)
    assert links.count() == 40 and "a_z" not in links._jdf.queryExecution().toString()
