import time

import pytest
from pyspark.sql import functions as F

from symdiff.functions import json
from symdiff.operators import analytics, gossip, iblt, sets
from symdiff.sources import files
from symdiff.streaming import incremental


def nodes_of(spark, n):
    return spark.range(n).select(F.col("id").alias("node"))


def test_components_of_a_path_and_an_isolated_node(spark):
    edges = [(i, i + 1) for i in range(9)]
    both = spark.createDataFrame(edges + [(b, a) for a, b in edges], "src long, dst long")
    got = {r.node: r.component for r in gossip.components(nodes_of(spark, 11), both).collect()}
    assert got == {i: 0 for i in range(10)} | {10: 10}
    assert not gossip.is_connected(nodes_of(spark, 11), both)


def test_gossip_finishes_and_retrieves(spark):
    every = nodes_of(spark, 6)
    state, rounds = gossip.run(every, gossip.complete_network(every))
    assert 0 < rounds < 64 and {r.origins for r in gossip.received(state).collect()} == {6}
    held = sets.assign(spark.range(60).select(F.col("id").alias("key")), 6, 0.9).select(F.col("party").alias("node"), "key")
    found = gossip.retrieved(state, held, iblt.Spec(400, 4))
    partial = {r.key for r in held.groupBy("key").count().where("count < 6").collect()}
    for node in range(6):
        own = [r for r in found.where(F.col("node") == node).collect() if r.key is not None]
        assert {r.key for r in own} == partial
    assert {r.percent for r in gossip.transmitted(found, held, 6).collect()} == {100.0}


def test_records_round_trip(spark, tmp_path):
    path = tmp_path / "runs.json"
    path.write_text('{\n  "n": 1,\n  "xs": [1, 2]\n}\n{\n  "n": 2,\n  "xs": []\n}\n')
    rows = files.read_records(spark, str(path), "n long, xs array<long>").collect()
    assert sorted((r.n, r.xs) for r in rows) == [(1, [1, 2]), (2, [])]
    files.write_records(spark.createDataFrame(rows), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out"), wholetext=True).count() > 0


def test_directories_leave_dotfiles_out(spark, tmp_path):
    for name in ("a.txt", "sub/b.txt", ".hidden/c.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    assert {r.path for r in files.read_directory(spark, str(tmp_path)).collect()} == {"a.txt", "sub/b.txt"}
    one = files.read_file(spark, str(tmp_path / "a.txt")).first()
    assert one.length == 5 and len(one.sha1) == 20


def test_written_files(spark, tmp_path):
    chunks = spark.createDataFrame([(1, 1, b"cd"), (1, 0, b"ab"), (2, 0, b"")], "doc_id long, chunk_no long, data binary")
    files.write_files(chunks, str(tmp_path / "f"))
    assert {r.doc_id: bytes(r.content) for r in spark.read.parquet(str(tmp_path / "f")).collect()} == {1: b"abcd", 2: b""}


def test_json_values(spark):
    df = spark.createDataFrame([('{"a": {"b": [1, 2]}, "s": "x"}',), ("no json",), (None,)], "t string")
    v = json.parse(F.col("t"))
    rows = df.select(json.get(v, "$.a.b[1]", "int"), json.get(v, "$.zz", "int", 7), json.is_member(F.col("t"), "s"), json.size(F.col("t"))).collect()
    assert tuple(rows[0]) == (2, 7, True, 2) and rows[1][0] is None and rows[2][1] == 7
    other = spark.range(1).select(json.appended(F.array(F.lit(1)), F.lit(2)), json.resized(F.array(F.lit(1)), 3), json.without_member(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), "a"))
    assert tuple(other.first()) == ([1, 2], [1, None, None], {"b": 2})


def test_summaries(spark):
    df = spark.createDataFrame([("x", 1, 4.0), ("x", 1, 2.0), ("x", 2, 3.0), ("x", 9, 0.0)], "g string, s long, v double")
    means = analytics.group_means(df, "g", "s", "v", 1, 5)
    assert analytics.best_setting(means, "g", "s").first().best == 1
    bins = {r.bin: r.n for r in analytics.histogram(df, "g", F.col("v"), [0, 2, 4]).collect()}
    assert bins == {0: 1, 1: 3}
    assert analytics.sweep(df.select("g").distinct(), 10, F.lit(30), 10).count() == 3


def test_fill_ratio_falls(spark):
    rows = {r["keys"]: r.percent_peeled for r in analytics.fill_ratios(spark, 512, 4, [200, 1000], 2).collect()}
    assert rows[200] == 100.0 and rows[1000] < 50


def test_streamed_windows_decode(spark, tmp_path):
    source = tmp_path / "in"
    rows = [("2024-01-01 00:00:01", 1, 1), ("2024-01-01 00:00:02", 2, 1), ("2024-01-01 00:00:03", 2, -1), ("2024-01-01 02:00:00", 9, 1)]
    schema = "ts timestamp, key long, sign int"
    df = spark.createDataFrame(rows, "ts string, key long, sign int").selectExpr("cast(ts as timestamp) ts", "key", "sign")
    df.coalesce(1).write.parquet(str(source))
    spec, seen = iblt.Spec(80, 4), []
    cells = incremental.windowed_cells(spark.readStream.schema(schema).parquet(str(source)), spec, "ts", "1 hour", "1 minute")

    def sink(batch, _):
        for r in iblt.peel_each(batch.withColumn("w", F.col("window.start").cast("string")), spec, "w").collect():
            seen.append((r.w, r.key, r.sign))

    query = incremental.start(cells, sink, str(tmp_path / "cp"), once=True)
    query.awaitTermination(120)
    deadline = time.time() + 5
    while not seen and time.time() < deadline:
        time.sleep(0.2)
    assert ("2024-01-01 00:00:00", 1, 1) in seen and not any(k == 2 for _, k, _ in seen)


def test_a_network_that_is_not_connected_is_an_error(spark):
    nodes = spark.createDataFrame([(i,) for i in range(4)], "node long")
    edges = spark.createDataFrame([(0, 1), (1, 0), (2, 3), (3, 2)], "src long, dst long")
    with pytest.raises(ValueError, match="not every node"):
        gossip.run(nodes, edges, 3)


def test_values_at_paths(spark):
    cases = [("{}", "$.a", "1", '{"a":1}'), ("null", "$[2].x", '"é"', '[null,null,{"x":"é"}]'), ('{"a":[1,2]}', "$.a[0]", "[]", '{"a":[[],2]}'), ('{"a":1}', "$.a.b", "1", None), ('{"a":1}', "$[0]", "1", None), ("{", "$.a", "1", None), (None, "$.a", "1", None), ("{}", "$.a", None, None), ('{"a":1}', "$", "2", "2")]
    for text, path, value, want in cases:
        df = spark.createDataFrame([(text, value)], "t string, v string")
        assert df.select(json.made(F.col("t"), path, F.col("v")).alias("x")).first().x == want
    for path in ("a", "$a", "$.a[", "$.a[x]", "$..a"):
        with pytest.raises(ValueError):
            json.steps(path)


def test_problems_of_texts(spark):
    cases = {"": (0, 1), '{"a": 1}': (None, None), '{"a": }': (6, 1), "[1,\n2": (5, 2), '{"a" 1}': (5, 1), "nul": (0, 1), "[1] x": (4, 1)}
    rows = spark.createDataFrame([(t,) for t in cases] + [(None,), ("[NaN]",)], "t string").select("t", json.problem("t").alias("p")).collect()
    assert {r.t: (r.p["at"], r.p["line"]) for r in rows if r.t in cases} == cases
    assert all((r.p["message"] is None) == (r.t in (None, '{"a": 1}')) for r in rows)
