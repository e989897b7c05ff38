import random

import pytest
from pyspark.sql import functions as F

from symdiff.operators import iblt, multiparty, multisets, sets, strata
from symdiff.plans.reconcile import reconcile
from symdiff.plans.tables import settled


def keys(spark, values):
    return spark.createDataFrame([(v,) for v in values], "key long")


def cells(df):
    return {tuple(r) for r in df.select("sub", "cell", *iblt.SUMS).collect()}


def two(n=300, seed=1):
    r = random.Random(seed)
    every = r.sample(range(1 << 62), n)
    return set(every[: n - 20]), set(every[20:])


def test_decode_gives_both_sides(spark):
    a, b = two()
    got = {(r.side, r.key) for r in reconcile(keys(spark, a), keys(spark, b)).collect()}
    assert got == {("A", k) for k in a - b} | {("B", k) for k in b - a}


def test_rounds_over_the_cluster_agree(spark):
    a, b = two()
    spec = iblt.Spec(160, 4)
    found, ok = iblt.peel_rounds(iblt.difference_table(keys(spark, a), keys(spark, b), spec), spec)
    assert ok and {(r.key, r.sign) for r in found.collect()} == {(k, 1) for k in a - b} | {(k, -1) for k in b - a}


def test_undersized_table_is_not_called_complete(spark):
    a, b = two()
    spec = iblt.Spec(12, 4)
    found, ok = iblt.decode(iblt.difference_table(keys(spark, a), keys(spark, b), spec), spec)
    assert not ok and {r.key for r in found.collect()} <= a ^ b


@pytest.mark.parametrize("name", ["murmur", "portable"])
def test_building_is_linear(spark, name):
    a, b = two()
    spec = iblt.Spec(100, 3, name)
    x, y = iblt.build(keys(spark, a), spec), iblt.build(keys(spark, b), spec)
    assert cells(iblt.add(x, y)) == cells(iblt.build(keys(spark, a).unionByName(keys(spark, b)), spec))
    assert cells(iblt.subtract(x, y)) == cells(iblt.difference_table(keys(spark, a), keys(spark, b), spec))
    assert iblt.is_empty(iblt.subtract(x, x))
    assert cells(iblt.build(keys(spark, a).repartition(7), spec)) == cells(x)


def test_wire_form_is_an_identity(spark):
    x = iblt.build(keys(spark, two()[0]), iblt.Spec(100)).withColumn("one", F.lit(1))
    assert cells(iblt.from_wire(iblt.to_wire(x, "one"), "one")) == cells(x)


def test_spec_rules():
    assert iblt.Spec(10, 4).m == 12 and iblt.Spec(0, 3).m == 3
    with pytest.raises(ValueError, match="k must be"):
        iblt.Spec(10, 16)
    with pytest.raises(ValueError, match="shape"):
        iblt.same_shape(iblt.Spec(10), iblt.Spec(20))


@pytest.mark.parametrize("d", [10, 100, 1000])
def test_strata_estimate_is_within_a_factor_of_two(spark, d):
    a = spark.range(5000).select(F.col("id").alias("key"))
    b = spark.range(d, 5000).select(F.col("id").alias("key"))
    assert d / 2 <= strata.estimate(a, b) <= 2 * d


@pytest.mark.parametrize("parts", [None, 1])
def test_theta_difference_is_exact_beyond_a_sketch(spark, parts):
    """20,000 and 16,000 keys, where a sketch holds 4,096; sketches that get too many are split."""
    a, b = spark.range(20_000).select(F.col("id").alias("key")), spark.range(7_000, 23_000).select(F.col("id").alias("key"))
    assert strata.theta_difference(a, b, parts).first().n == 10_000
    assert strata.theta_difference(a.limit(0), b.limit(0)).first().n == 0 and strata.theta_difference(a, b.limit(0)).first().n == 20_000


def test_equal_and_empty_sets(spark):
    a = keys(spark, range(50))
    assert strata.estimate(a, a) == 0 and reconcile(a, a).count() == 0
    assert reconcile(a.limit(0), a.limit(0)).count() == 0


def members(spark, n=400, parties=3, seed=2):
    r = random.Random(seed)
    rows = [(p, k) for k in r.sample(range(1 << 32), n) for p in range(parties) if r.random() < 0.9]
    return spark.createDataFrame(rows, "party long, key long"), rows


def test_many_parties_decode_what_not_all_have(spark):
    df, rows = members(spark)
    counts = {}
    for _, k in rows:
        counts[k] = counts.get(k, 0) + 1
    spec = iblt.Spec(600, 4)
    got = multiparty.decode(multiparty.build(df, spec, 3), spec, 3).collect()
    assert all(r.ok for r in got) and {r.key: r.coefficient for r in got} == {k: c for k, c in counts.items() if c < 3}


def test_segments_of_many_parties(spark, monkeypatch):
    """No task decodes a table of more than a few times a segment's cells, and segments that fail are made again."""
    sizes = []
    build = multiparty.build
    monkeypatch.setattr(multiparty, "SEGMENT_CELLS", 128)
    monkeypatch.setattr(multiparty, "build", lambda rows, spec, *a: sizes.append(spec.m) or build(rows, spec, *a))
    rows = [(p, k) for k in range(1500) for p in range(3) if k % 4 == 0 or (k + p) % 3 < 2 and k % 7 != p]
    found = multiparty.reconcile(spark.createDataFrame(rows, "party long, key long"), 3, 1500)
    want = {}
    for _, k in rows:
        want[k] = want.get(k, 0) + 1
    assert sorted((r.key, r.coefficient) for r in found.collect()) == sorted((k, n) for k, n in want.items() if n < 3)
    assert sizes[0] <= 128 and max(sizes) <= 512


def test_scaling_and_subtracting(spark):
    df, _ = members(spark, 40)
    spec = iblt.Spec(40, 4)
    t = multiparty.build(df, spec, 7)
    assert multiparty.subtract(t, t, 7).isEmpty()
    three = multiparty.add(multiparty.add(t, t, 7), t, 7)
    rows = lambda x: {tuple(r) for r in x.select("sub", "cell", "kind", "nit", "v").collect()}
    assert rows(multiparty.scale(t, 3, 7)) == rows(three)


def test_pure_cells_hold_their_key(spark):
    df = spark.createDataFrame([(5,), (77,)], "key long")
    spec = iblt.Spec(400, 4)
    assert {r.key for r in multiparty.pure(multiparty.build(df, spec, 5), spec).collect()} == {5, 77}


def test_set_algebra(spark):
    a, b = two()
    x, y = keys(spark, a), keys(spark, b)
    as_set = lambda df: {r.key for r in df.collect()}
    assert as_set(sets.union(x, y)) == a | b and as_set(sets.intersection(x, y)) == a & b
    assert as_set(sets.difference(x, y)) == a - b and as_set(sets.symmetric_difference(x, y)) == a ^ b


def test_nulls_and_copies_of_keys_are_left_out(spark):
    assert sets.key_set(spark.createDataFrame([(1,), (1,), (None,)], "key long")).count() == 1


def test_generators(spark):
    assert sets.distinct_keys(spark, 2000).distinct().count() == 2000
    numbered = spark.range(30).select(F.col("id").alias("number"), (F.col("id") + 100).alias("key"))
    rows = sets.shared_and_distinct(numbered, 5, 3, 2).collect()
    assert sum(r.party == 0 for r in rows) == 8 and len({r.key for r in rows}) == 11
    share = sets.assign(numbered.select("key"), 50, 0.3).count() / 1500
    assert 0.2 < share < 0.4


def test_settled_tables_can_be_read_again(spark):
    df = settled(spark.range(3))
    assert df.count() == 3 and df.columns == ["id"]


def test_a_multisets_sketch_is_sized_at_once(spark, monkeypatch):
    """12,000 rows differ: one sketch is made, where sketches of 1,024 cells and eight times more failed before."""
    made = []
    peel = multisets.peel
    monkeypatch.setattr(multisets, "peel", lambda cells, spec: made.append(spec.m) or peel(cells, spec))
    key = (F.xxhash64("id").bitwiseAND(F.lit((1 << 60) - 1))).alias("key")
    a, b = spark.range(20_000).select(key), spark.range(8_000, 24_000).unionByName(spark.range(9_000, 10_000)).select(key)
    found = multisets.differences(a, b).groupBy("times").count().collect()
    assert {r.times: r["count"] for r in found} == {1: 8_000, -1: 5_000} and len(made) == 1


def test_sums_of_halves_give_the_same_cells(spark):
    rows = spark.range(2_000).select((F.xxhash64("id").bitwiseAND(F.lit((1 << 60) - 1))).alias("key"), F.when(F.col("id") % 3 == 0, -1).otherwise(1).alias("times"))
    spec = iblt.Spec(200, 4, "portable")
    assert sorted(map(tuple, multisets.counted(rows, spec).collect())) == sorted(map(tuple, multisets.build(rows, spec).collect()))
