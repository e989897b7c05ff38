"""Pairs of similar sets against all pairs; chunks that edits leave alone; multisets of rows."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from symdiff.operators import fingerprint, iblt, multisets, similar


def all_pairs(sets, percent):
    reps = {}
    for d in sorted(sets):
        reps.setdefault(frozenset(sets[d]), d)
    kept = sorted(reps.values())
    pairs = {(a, b, len(sets[a] & sets[b]), len(sets[a] | sets[b])) for i, a in enumerate(kept) for b in kept[i + 1 :] if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    return pairs, {(d, reps[frozenset(s)]) for d, s in sets.items()}


def random_sets(rng, n):
    out = {}
    for d in range(n):
        if out and rng.random() < 0.7:
            s = set(out[rng.choice(list(out))])
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                (s.discard if rng.random() < 0.5 else s.add)(rng.randrange(60))
        else:
            s = set(rng.sample(range(60), rng.randint(1, 30)))
        if s:
            out[d] = s
    return out


@pytest.mark.parametrize(("percent", "split"), [(80, 1 << 12), (80, 4), (50, 4), (100, 4), (1, 1 << 12)])
def test_pairs_match_all_pairs(spark, monkeypatch, percent, split):
    monkeypatch.setattr(similar, "LIST", split)
    sets = random_sets(random.Random(percent), 120 if percent > 1 else 40)
    rows = [(d, h) for d, s in sets.items() for h in s]
    df = spark.createDataFrame([*rows, *rows[:50], (None, 5), (7, None)], "doc_id long, h long")
    pairs, members = similar.similar_pairs(df, percent)
    want, classes = all_pairs(sets, percent)
    got = [tuple(r) for r in pairs.collect()]
    assert set(got) == want and len(got) == len(want) and {tuple(r) for r in members.collect()} == classes


def test_no_sets(spark):
    pairs, members = similar.similar_pairs(spark.createDataFrame([], "doc_id long, h long"), 80)
    assert pairs.count() == 0 and members.count() == 0
    with pytest.raises(ValueError):
        similar.similar_pairs(spark.createDataFrame([], "doc_id long, h long"), 0)


def test_size_classes_hold_all_similar_sizes(spark):
    sizes = [*range(1, 300), 10**6, 10**6 + 1, 1_250_000, 1_250_001]
    for percent in (80, 33):
        level = {r.n: r.c for r in spark.createDataFrame([(n,) for n in sizes], "n int").select("n", similar.size_class(F.col("n"), percent).alias("c")).collect()}
        assert all(level[y] - level[x] in (0, 1) for x in sizes for y in sizes if x <= y and 100 * x >= percent * y)


def test_two_way_minimum_is_the_definition_and_edits_stay_local():
    rng = random.Random(4)
    data = bytes(rng.choice(b"abcdef ") for _ in range(20_000))
    reach = 40
    h = [(int(x), i) for i, x in enumerate(fingerprint.rolling_hashes(data))]
    want = [i + 1 for i in range(reach, len(h) - reach) if min(h[i - reach : i + reach + 1]) == h[i]]
    at, hashes = fingerprint.two_way_minimum(data, reach)
    assert at.tolist() == want and hashes.tolist() == [h[i - 1][0] for i in want] and min(b - a for a, b in zip(want, want[1:])) > reach
    where = 9_000
    edited = data[:where] + b"XYZ" + data[where + 1 :]
    moved = fingerprint.two_way_minimum(edited, reach)[0].tolist()
    margin = reach + fingerprint.TERMS + 1
    before, after = {x for x in want if x < where - margin}, {x + 2 for x in want if x > where + margin}
    assert before == {x for x in moved if x < where - margin} and after == {x for x in moved if x > where + 2 + margin}
    for short in (b"", b"x" * 2 * reach):
        assert not len(fingerprint.two_way_minimum(short, reach)[0])


def test_multisets_differ_by_how_often(spark):
    rng = random.Random(5)
    a = [rng.randrange(400) for _ in range(3000)]
    b = [x for x in a if x > 5] + [1000, 1000, 1000, 7]
    rng.shuffle(b)
    one, two = (spark.createDataFrame([(x, "t") for x in y], "x long, t string").select(multisets.row_key("x", "t").alias("key")) for y in (a, b))
    name = {r.key: r.x for r in spark.createDataFrame([(x, "t") for x in {*a, *b}], "x long, t string").select("x", multisets.row_key("x", "t").alias("key")).collect()}
    want = collections.Counter(a)
    want.subtract(b)
    assert {name[r.key]: r.times for r in multisets.differences(one, two).collect()} == {k: v for k, v in want.items() if v}
    assert multisets.digest(one).first() == multisets.digest(one.repartition(7)).first() != multisets.digest(two).first()
    parts = [multisets.digest(one.where(f"key % 2 = {k}")).first() for k in (0, 1)]
    assert tuple(x + y for x, y in zip(*parts)) == tuple(multisets.digest(one).first())
    assert multisets.differences(one, one.orderBy("key")).count() == 0


def test_multiset_sketches_add_up_and_say_when_they_are_full(spark):
    spec = iblt.Spec(40, 4, "portable")
    rows = spark.range(200).select((F.col("id") * 7919).alias("key"))
    found, complete = multisets.peel(multisets.build(rows, spec), spec)
    assert not complete
    both = multisets.add(multisets.build(rows, spec), multisets.negated(multisets.build(rows.where("key > 7919 * 5"), spec)))
    found, complete = multisets.peel(both, spec)
    assert complete and sorted(tuple(r) for r in found.collect()) == [(7919 * k, 1) for k in range(6)]


def test_row_keys_tell_nulls_and_limits_apart(spark):
    df = spark.createDataFrame([(None, "a"), ("-", "a"), ("", "a"), ("a", ""), ("a", None), ("1:a", "")], "x string, y string")
    assert df.select(multisets.row_key("x", "y").alias("k")).distinct().count() == 6
    assert multisets.digest(df.where("false").select(multisets.row_key("x").alias("key"))).first() == (0, 0, 0)
