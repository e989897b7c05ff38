"""Plans of renames, carried out one by one on a dictionary, and distributed ranks."""

import random

import pytest
from pyspark.sql import functions as F

from symdiff.operators import moves, sets


def frame(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, content_sha1 string")


def carried_out(mine, theirs, plan):
    """Step by step; within a step in any order. Fails if a rename overwrites what is still needed."""
    state, fetched = dict(theirs), 0
    rng = random.Random(1)
    rows = sorted(plan, key=lambda r: (r.phase, r.step, rng.random()))
    for r in rows:
        if r.action == "fetch":
            state[r.target] = mine[r.target]
            fetched += 1
        elif r.action == "copy":
            state[r.target] = state[r.source]
        elif r.action == "rename":
            assert state[r.source] == r.content
            state[r.target] = state.pop(r.source)
        else:
            del state[r.source]
    return state, fetched


def check(spark, mine, theirs):
    a, b = frame(spark, mine), frame(spark, theirs)
    plan = moves.move_plan(a, b).persist()
    rows = plan.collect()
    state, fetched = carried_out(mine, theirs, rows)
    assert state == mine and fetched == sum(c not in theirs.values() for c in mine.values())
    assert {r.path: r.content_sha1 for r in moves.applied(b, plan).collect()} == mine
    sources = [r.source for r in rows if r.action == "rename" and not r.source.endswith(moves.ASIDE)]
    assert len(sources) == len(set(sources))
    return rows


def test_chains_cycles_copies(spark):
    mine = {**{f"c{i}": f"x{i}" for i in range(13)}, "a": "1", "b": "2", "p": "3", "q": "3", "r": "3", "same": "s", "again": "s", "new": "n", "self": "t"}
    theirs = {**{f"c{(i + 1) % 13}": f"x{i}" for i in range(13)}, "a": "2", "b": "1", "old": "3", "same": "s", "gone": "g", "self": "u"}
    rows = check(spark, mine, theirs)
    assert sorted(r.action for r in rows if r.phase != 1) == ["copy", "copy", "copy", "delete", "fetch", "fetch"]
    assert sum(r.action == "rename" for r in rows) == 14 + 3 + 1


def test_a_long_chain_takes_few_rounds(spark):
    n = 70
    mine = {f"f{i:03}": f"x{i}" for i in range(n)}
    theirs = {f"f{i + 1:03}": f"x{i}" for i in range(n)}
    rows = check(spark, mine, theirs)
    assert sorted(r.step for r in rows) == list(range(n))


@pytest.mark.parametrize("seed", [1, 2])
def test_random_directories(spark, seed):
    rng = random.Random(seed)
    contents = [f"x{k}" for k in range(25)]
    mine, theirs = ({f"f{i}": rng.choice(contents) for i in rng.sample(range(60), 45)} for _ in range(2))
    check(spark, mine, theirs)


def test_edges(spark):
    check(spark, {}, {})
    check(spark, {"a": "1"}, {})
    check(spark, {}, {"a": "1"})
    check(spark, {"a": "1"}, {"a": "1"})


def test_ranks_of_spread_groups(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("x"), F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 5).cast("string")).alias("g"))
    got = sets.ranked(df, ["g"], ["x"], "place").collect()
    groups = {}
    for r in sorted(got, key=lambda r: r.x):
        groups.setdefault(r.g, []).append(r.place)
    assert all(p == list(range(len(p))) for p in groups.values()) and len(got) == 1000
    assert [r.place for r in sorted(sets.ranked(df.select("x"), [], ["x"], "place").collect(), key=lambda r: r.x)] == list(range(1000))
