"""Multi-party tables decoded by rounds, against sets."""

import collections
import random

import pytest

from symdiff.operators import iblt, peeling


def members(n_keys, parties, seed, whole=0.5, bits=32):
    """{key: parties}: about `whole` of the keys are everybody's."""
    rng = random.Random(seed)
    signed = lambda k: k - (1 << 64) if k >> 63 else k
    keys = rng.sample(range(1 << bits), n_keys) if bits < 63 else [signed(rng.getrandbits(64)) for _ in range(n_keys)]
    return {k: set(range(parties)) if rng.random() < whole else set(rng.sample(range(parties), rng.randint(1, parties))) for k in keys}


def frame(spark, held, kind="long"):
    return spark.createDataFrame([(p, k) for k, ps in held.items() for p in ps], f"party int, key {kind}")


@pytest.mark.parametrize(("parties", "bits", "n"), [(2, 32, 200), (3, 64, 200), (6, 32, 200), (70, 32, 40)])
def test_holders_are_told(spark, parties, bits, n):
    held = members(n, parties, parties, bits=bits)
    want = {k: (len(ps), sorted(ps)) for k, ps in held.items() if len(ps) < parties}
    got = peeling.reconcile(frame(spark, held), parties, bits, holders=True).collect()
    assert {r.key: (r.coefficient, r.parties) for r in got} == want and len(got) == len(want)


def test_half_of_an_even_number_of_parties(spark):
    """Such sets and what they leave out have the same size; the cells' totals tell them apart."""
    rng = random.Random(5)
    held = {k: set(rng.sample(range(4), 2)) if k % 3 else set(range(4)) for k in range(150)}
    got = peeling.reconcile(frame(spark, held), 4, holders=True).collect()
    assert {r.key: r.parties for r in got} == {k: sorted(p) for k, p in held.items() if len(p) < 4}


def test_byte_strings(spark):
    rng = random.Random(6)
    held = {bytearray(rng.randbytes(12)).hex(): set(rng.sample(range(3), rng.randint(1, 3))) for _ in range(150)}
    got = peeling.reconcile(frame(spark, held, "string").selectExpr("party", "unhex(key) as key"), 3, 96, holders=True).collect()
    assert {bytes(r.key).hex(): r.parties for r in got} == {k: sorted(p) for k, p in held.items() if len(p) < 3}


def test_tables_add_up_and_groups_stay_apart(spark):
    shape = peeling.Shape(iblt.Spec(200, 4), 3, parties=3)
    held = {g: members(60, 3, 10 + g) for g in (1, 2)}
    tables = [peeling.build(spark.createDataFrame([(g, p, k) for g, h in held.items() for k, ps in h.items() for p in ps if p in some], "g int, party int, key long"), shape, "g") for some in ({0}, {1, 2})]
    found, left = peeling.peel_rounds(peeling.add(*tables, shape, "g"), shape, "g")
    want = collections.defaultdict(dict)
    for r in found.collect():
        want[r.g][r.key] = set(r.parties)
    assert want == {g: {k: ps for k, ps in h.items() if len(ps) < 3} for g, h in held.items()} and left.isEmpty()


def test_an_overfull_table_says_so_and_gives_no_wrong_key(spark):
    held = members(300, 3, 20, whole=0)
    shape = peeling.Shape(iblt.Spec(80, 4), 3)
    found, left = peeling.peel_rounds(peeling.build(frame(spark, held), shape), shape)
    assert not left.isEmpty()
    assert all(len(held.get(r.key, ())) == r.coefficient for r in found.collect())


def test_edges(spark):
    empty = spark.createDataFrame([], "party int, key long")
    assert peeling.reconcile(empty, 3).collect() == []
    one = spark.createDataFrame([(0, 7), (0, 7), (None, 8), (1, None)], "party int, key long")
    assert [(r.key, r.coefficient, r.parties) for r in peeling.reconcile(one, 3, holders=True).collect()] == [(7, 1, [0])]
    same = frame(spark, dict.fromkeys(range(50), {0, 1, 2}))
    assert peeling.reconcile(same, 3, holders=True).collect() == []
    for wrong in ({"key_bits": 40}, {"key_bits": 96}, {"parties": 2}, {"is_string": True}):
        with pytest.raises(ValueError):
            peeling.Shape(iblt.Spec(80, 4), 3, **wrong)


def test_estimates_are_near(spark):
    held = members(1500, 3, 30, whole=0.7)
    partial = sum(len(p) < 3 for p in held.values())
    assert partial / 2 <= peeling.partial_estimate(frame(spark, held)) <= 4 * partial


def test_no_task_gets_a_whole_table(spark):
    shape = peeling.Shape(iblt.Spec(200, 4), 3)
    table = peeling.build(frame(spark, members(50, 3, 40)), shape)
    plan = peeling.pure(table, shape)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Python" not in plan and "Pandas" not in plan
