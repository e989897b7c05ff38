"""The registered queries, each with the DuckDB SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symdiff.functions import field, hashing, json
from symdiff.functions.arrow import in_small_batches
from symdiff.functions.unsigned import as_decimal, wrapping
from symdiff.operators import analytics, codec, filesync, fingerprint, gossip, iblt, moves, multiparty, multisets, peeling, protocol, sets, similar, strata, strings
from symdiff.plans.reconcile import reconcile, reconcile_directories
from symdiff.plans.tables import settled, shared_folder, table
from symdiff.sources import sketches
from symdiff.streaming import reconcile as reconcile_streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# Key sets: the customers of urgent orders and of high-priority ones, and orders against the line items' orders.

URGENT, HIGH = "1-URGENT", "2-HIGH"
URGENT_SQL, HIGH_SQL = (f"SELECT DISTINCT o_custkey AS key FROM orders WHERE o_orderpriority = '{p}'" for p in (URGENT, HIGH))
ORDERS_SQL, LINES_SQL = "SELECT o_orderkey AS key FROM orders", "SELECT DISTINCT l_orderkey AS key FROM lineitem"


def customers(spark: SparkSession, sf_dir: str, priority: str) -> DataFrame:
    return sets.key_set(table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == priority), "o_custkey")


def two_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return customers(spark, sf_dir, URGENT), customers(spark, sf_dir, HIGH)


def order_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return sets.key_set(table(spark, sf_dir, "orders"), "o_orderkey"), sets.key_set(table(spark, sf_dir, "lineitem"), "l_orderkey")


#: Parties: the five order priorities; keys: their customers.
PARTIES = 5
MEMBERS_SQL = "SELECT DISTINCT substr(o_orderpriority, 1, 1)::BIGINT - 1 AS party, o_custkey AS key FROM orders"


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    party = F.substring("o_orderpriority", 1, 1).cast("long") - 1
    return table(spark, sf_dir, "orders").select(party.alias("party"), F.col("o_custkey").alias("key")).distinct()


# SQL builders


def portable_sql(key: str, seed: int) -> str:
    return f"('0x' || substr(md5('{seed}:' || {key}), 1, 15))::BIGINT"


def cells_sql(signed: str, spec: iblt.Spec) -> str:
    """The cells of `signed`: SQL for (key, sign)."""
    places = ", ".join(f"({portable_sql('key', i + 1)} % {spec.per_sub})::INT AS c{i}" for i in range(spec.k))
    rows = " UNION ALL ".join(f"SELECT {i} AS sub, c{i} AS cell, key, chk, sign FROM p" for i in range(spec.k))
    return f"""
    WITH s AS ({signed}), p AS (SELECT key, sign, {portable_sql("key", 0)} AS chk, {places} FROM s), r AS ({rows})
    SELECT sub, cell, bit_xor(key) AS key_sum, bit_xor(chk) AS hash_sum, sum(sign)::BIGINT AS cnt FROM r GROUP BY ALL
    HAVING bit_xor(key) <> 0 OR bit_xor(chk) <> 0 OR sum(sign) <> 0
    """


def murmur_sql(keys: str, seed: int, key_bytes: int = 8) -> str:
    """(key, h UHUGEINT) of `keys`: SQL for (key)."""
    p, m = "18446744073709551616::UHUGEINT", f"{hashing.M64}::UHUGEINT"
    start = f"{(seed ^ (key_bytes * hashing.M64)) & ((1 << 64) - 1)}::UHUGEINT"
    return f"""
    (WITH k0 AS ({keys}), k1 AS (SELECT key, (key::UHUGEINT * {m}) % {p} AS k FROM k0), k2 AS (SELECT key, (xor(k, k >> 47) * {m}) % {p} AS k FROM k1),
    h1 AS (SELECT key, (xor({start}, k) * {m}) % {p} AS h FROM k2), h2 AS (SELECT key, (xor(h, h >> 47) * {m}) % {p} AS h FROM h1)
    SELECT key, xor(h, h >> 47) AS h FROM h2)
    """


NTZ_SQL = "CASE WHEN h = 0 THEN 64 ELSE length(regexp_extract(bin(h::UBIGINT), '0*$')) END::INT"

# Two-party tables

PORTABLE = iblt.Spec(400, 4, "portable")


@query(f"SELECT 'A' AS side, key FROM (({URGENT_SQL}) EXCEPT ({HIGH_SQL})) UNION ALL SELECT 'B' AS side, key FROM (({HIGH_SQL}) EXCEPT ({URGENT_SQL}))")
def iblt_decode_two_party(spark, sf_dir):
    return reconcile(*two_sets(spark, sf_dir))


@query(f"(({ORDERS_SQL}) EXCEPT ({LINES_SQL})) UNION (({LINES_SQL}) EXCEPT ({ORDERS_SQL}))")
def iblt_decode_union(spark, sf_dir):
    return reconcile(*order_sets(spark, sf_dir)).select("key").distinct()


@query(cells_sql(f"SELECT key, 1 AS sign FROM ({URGENT_SQL})", PORTABLE))
def iblt_build_cells(spark, sf_dir):
    return iblt.build(customers(spark, sf_dir, URGENT), PORTABLE)


@query(cells_sql(f"SELECT key, 1 AS sign FROM ({URGENT_SQL}) UNION ALL SELECT key, 1 FROM ({HIGH_SQL})", PORTABLE))
def iblt_merge_linear(spark, sf_dir):
    a, b = two_sets(spark, sf_dir)
    return iblt.add(iblt.build(a, PORTABLE), iblt.build(b, PORTABLE))


SUBTRACTED_SQL = cells_sql(f"SELECT key, 1 AS sign FROM ({URGENT_SQL}) UNION ALL SELECT key, -1 FROM ({HIGH_SQL})", PORTABLE)


@query(SUBTRACTED_SQL)
def iblt_subtract_cells(spark, sf_dir):
    a, b = two_sets(spark, sf_dir)
    return iblt.subtract(iblt.build(a, PORTABLE), iblt.build(b, PORTABLE))


@query(f"SELECT sub, cell, key_sum AS key, cnt FROM ({SUBTRACTED_SQL}) WHERE abs(cnt) = 1 AND {portable_sql('key_sum', 0)} = hash_sum")
def iblt_pure_cells(spark, sf_dir):
    return iblt.pure(iblt.difference_table(*two_sets(spark, sf_dir), PORTABLE), PORTABLE).select("sub", "cell", F.col("key_sum").alias("key"), "cnt")


@query(f"SELECT 'A' AS side, key FROM (({URGENT_SQL}) EXCEPT ({HIGH_SQL})) UNION ALL SELECT 'B' AS side, key FROM (({HIGH_SQL}) EXCEPT ({URGENT_SQL}))")
def iblt_decode_rounds(spark, sf_dir):
    """The same by rounds over the cluster, as for tables that no single task should hold."""
    a, b = (settled(x) for x in two_sets(spark, sf_dir))
    spec = iblt.Spec(max(2 * strata.estimate(a, b), 80), 4)
    while True:
        keys, complete = iblt.peel_rounds(iblt.difference_table(a, b, spec), spec)
        if complete:
            return keys.select(F.when(F.col("sign") > 0, "A").otherwise("B").alias("side"), "key")
        spec = iblt.Spec(2 * spec.m, 4)


@query(cells_sql(f"SELECT key, 1 AS sign FROM ({URGENT_SQL})", PORTABLE))
def iblt_wire_roundtrip(spark, sf_dir):
    cells = iblt.build(customers(spark, sf_dir, URGENT), PORTABLE).withColumn("one", F.lit(1))
    return iblt.from_wire(iblt.to_wire(cells, "one"), "one").drop("one")


@query(SUBTRACTED_SQL)
def iblt_codec_roundtrip(spark, sf_dir):
    """Cells, with counts of both signs, after they were packed into octets and read again."""
    return codec.unpacked(codec.packed(iblt.difference_table(*two_sets(spark, sf_dir), PORTABLE), PORTABLE), PORTABLE)


@query(cells_sql(f"SELECT key, 1 AS sign FROM ({ORDERS_SQL}) UNION ALL SELECT key, -1 FROM ({LINES_SQL})", PORTABLE))
def iblt_file_roundtrip(spark, sf_dir):
    """A table of cells, written to sketch files and read again."""
    sketches.register(spark)
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    iblt.difference_table(*order_sets(spark, sf_dir), PORTABLE).write.format("sketch").option("m", PORTABLE.m).option("k", PORTABLE.k).option("hash", PORTABLE.hash).mode("append").save(path)
    return spark.read.format("sketch").load(path)


@query(cells_sql(f"SELECT key, 1 AS sign FROM ({ORDERS_SQL}) UNION ALL SELECT key, -1 FROM ({LINES_SQL})", PORTABLE))
def iblt_remove_keys(spark, sf_dir):
    """Keys inserted and removed one by one: the signs add up in the cells."""
    a, b = order_sets(spark, sf_dir)
    return iblt.build(a.withColumn("sign", F.lit(1)).unionByName(b.withColumn("sign", F.lit(-1))), PORTABLE)


@query("SELECT * FROM (VALUES ('table', 64000::BIGINT), ('stratum', 12800::BIGINT), ('estimator', 819200::BIGINT)) AS t(what, bits)")
def iblt_size_bits(spark, sf_dir):
    rows = [("table", iblt.Spec(400, 4).size_in_bits()), ("stratum", strata.STRATUM.size_in_bits()), ("estimator", strata.size_in_bits())]
    return spark.createDataFrame(rows, "what string, bits long")


@query()
def iblt_fill_ratio(spark, sf_dir):
    return analytics.fill_ratios(spark, 4096, 4, [2048, 2560, 3072, 3584, 4096], 5)


# Strata

HASHED_KEYS_SQL = murmur_sql(URGENT_SQL, 0)


@query(f"SELECT least({NTZ_SQL}, 63) AS stratum, count(*) AS n FROM {HASHED_KEYS_SQL} GROUP BY ALL")
def strata_assignment(spark, sf_dir):
    return strata.assigned(customers(spark, sf_dir, URGENT)).groupBy("stratum").agg(F.count("*").alias("n"))


BOTH_SQL = f"(({URGENT_SQL}) EXCEPT ({HIGH_SQL})) UNION (({HIGH_SQL}) EXCEPT ({URGENT_SQL}))"


@query(f"SELECT least({NTZ_SQL}, 63) AS stratum, count(*) AS n_diff FROM {murmur_sql(BOTH_SQL, 0)} GROUP BY ALL")
def strata_exact_diff(spark, sf_dir):
    return strata.assigned(sets.symmetric_difference(*two_sets(spark, sf_dir))).groupBy("stratum").agg(F.count("*").alias("n_diff"))


@query(f"SELECT least({NTZ_SQL}, 63) AS stratum, count(*)::BIGINT AS n FROM {HASHED_KEYS_SQL} GROUP BY ALL")
def strata_wire_roundtrip(spark, sf_dir):
    """The keys that each stratum's first sub-table counts, after the estimator was written and read."""
    cells = strata.from_wire(strata.to_wire(strata.build(customers(spark, sf_dir, URGENT))))
    return cells.where("sub = 0").groupBy("stratum").agg(F.sum("cnt").alias("n")).where("n > 0")


STRATA_SEEDS = range(strata.STRATUM.k + 1)
STRATA_CELLS_SQL = f"""
WITH k AS (SELECT h AS key, least({NTZ_SQL}, {strata.STRATA - 1}) AS stratum FROM {HASHED_KEYS_SQL}),
{", ".join(f"m{i} AS (SELECT * FROM {murmur_sql('SELECT key FROM k', hashing.SEEDS[i])})" for i in STRATA_SEEDS)},
r AS ({" UNION ALL ".join(f"SELECT stratum, {i - 1} AS sub, (m{i}.h % {strata.STRATUM.per_sub})::INT AS cell, k.key, m0.h AS chk FROM k JOIN m0 USING (key) JOIN m{i} USING (key)" for i in STRATA_SEEDS[1:])})
SELECT stratum, sub, cell, bit_xor(key)::DECIMAL(20,0) AS key_sum, bit_xor(chk)::DECIMAL(20,0) AS hash_sum, count(*) AS cnt FROM r GROUP BY ALL
"""


@query(STRATA_CELLS_SQL)
def strata_codec_roundtrip(spark, sf_dir):
    """All cells of an estimator, after it was packed into octets and read again."""
    cells = codec.unpacked(codec.packed(strata.build(customers(spark, sf_dir, URGENT)), strata.STRATUM, strata=True), strata.STRATUM, strata=True)
    return cells.select("stratum", "sub", "cell", as_decimal(F.col("key_sum")).alias("key_sum"), as_decimal(F.col("hash_sum")).alias("hash_sum"), "cnt")


@query(f"SELECT count(*) AS n FROM ({BOTH_SQL})")
def theta_difference(spark, sf_dir):
    """By theta sketches, each of so few keys that it is exact."""
    return strata.theta_difference(*two_sets(spark, sf_dir)).select(F.round("n").cast("long").alias("n"))


@query()
def strata_accuracy(spark, sf_dir):
    return analytics.strata_accuracy(spark, [10, 100, 1000, 10_000, 100_000])


@query()
def strata_estimate(spark, sf_dir):
    rows = []
    for name, (a, b) in (("customers", two_sets(spark, sf_dir)), ("orders", order_sets(spark, sf_dir))):
        rows.append((name, strata.estimate(a, b), sets.symmetric_difference(a, b).count()))
    return spark.createDataFrame(rows, "sets string, estimate long, actual long")


# Hashes


@query(f"SELECT key, h::DECIMAL(20,0) AS h FROM {murmur_sql(ORDERS_SQL, 0)}")
def murmur64a_u64(spark, sf_dir):
    with wrapping(spark):
        return order_sets(spark, sf_dir)[0].select("key", as_decimal(hashing.murmur64a(F.col("key"))).alias("h"))


@query(" UNION ALL ".join(f"SELECT key, {i} AS seed, h::DECIMAL(20,0) AS h FROM {murmur_sql(URGENT_SQL, s)}" for i, s in enumerate(hashing.SEEDS)))
def murmur_seeds(spark, sf_dir):
    with wrapping(spark):
        each = F.array(*(F.struct(F.lit(i).alias("seed"), hashing.murmur64a(F.col("key"), s).alias("h")) for i, s in enumerate(hashing.SEEDS)))
        return customers(spark, sf_dir, URGENT).select("key", F.explode(each).alias("x")).select("key", "x.seed", as_decimal(F.col("x.h")).alias("h"))


MULTIPLIED = lambda x: f"(({x}) * {hashing.M32}) % 4294967296"
MURMUR32_SQL = f"""
WITH k AS (SELECT key, (key & 4294967295)::HUGEINT AS w0, (key >> 32)::HUGEINT AS w1 FROM ({ORDERS_SQL})),
m AS (SELECT key, {MULTIPLIED("w0")} AS a, {MULTIPLIED("w1")} AS b FROM k),
n AS (SELECT key, {MULTIPLIED("xor(a, a >> 24)")} AS a, {MULTIPLIED("xor(b, b >> 24)")} AS b FROM m),
h1 AS (SELECT key, xor({MULTIPLIED("8::HUGEINT")}, a) AS h, b FROM n), h2 AS (SELECT key, xor({MULTIPLIED("h")}, b) AS h FROM h1),
h3 AS (SELECT key, {MULTIPLIED("xor(h, h >> 13)")} AS h FROM h2) SELECT key, xor(h, h >> 15)::BIGINT AS h FROM h3
"""


@query(MURMUR32_SQL)
def murmur2_32(spark, sf_dir):
    return order_sets(spark, sf_dir)[0].select("key", hashing.murmur32(F.col("key")).alias("h"))


SIGNED_DIGITS = lambda k: f"(('0x' || substr(x, {2 * k + 1}, 2))::BIGINT - CASE WHEN ('0x' || substr(x, {2 * k + 1}, 2))::INT > 127 THEN 256 ELSE 0 END)"


@query(
    f"""WITH d AS (SELECT doc_id, right(hex(encode(text)), 8) AS x FROM documents)
    SELECT doc_id, CASE WHEN length(x) < 8 THEN 0 ELSE (({" + ".join(f"{SIGNED_DIGITS(k)} * {1 << 8 * (3 - k)}" for k in range(4))}) % 4294967296 + 4294967296) % 4294967296 END::BIGINT AS h FROM d"""
)
def null_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", hashing.null_hash(F.encode("text", "utf-8")).alias("h"))


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1 FROM documents")
def md5_sha1_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.encode("text", "utf-8")).alias("md5"), F.sha1(F.encode("text", "utf-8")).alias("sha1"))


@query()
def bob_hash(spark, sf_dir):
    data = F.encode("p_name", "utf-8")
    both = table(spark, sf_dir, "part").select("p_partkey", hashing.bob_hash(data).alias("h"), hashing.bob_hash_pair(data).alias("x"))
    return both.select("p_partkey", "h", "x.h1", "x.h2")


@query()
def superfast_hash(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", hashing.superfast_hash(F.encode("p_name", "utf-8")).alias("h"))


NUMBER_OF_BYTES = lambda at, n, whole: " + ".join(f"CASE WHEN {n} > {at + i} THEN ('0x' || substr(x, {2 * (at + i) + 1}, 2))::UHUGEINT * {1 << 8 * i}::UHUGEINT ELSE 0::UHUGEINT END" for i in range(whole))
#: Of texts of 4 to 15 bytes.
MURMUR_TEXT_SQL = f"""
WITH d AS (SELECT p_partkey, hex(encode(p_name)) AS x, octet_length(encode(p_name)) AS n FROM part),
w AS (SELECT p_partkey, n, {NUMBER_OF_BYTES(0, "n", 8)} AS a, {NUMBER_OF_BYTES(8, "n", 7)} AS b FROM d),
k1 AS (SELECT *, (a * {hashing.M64}::UHUGEINT) % 18446744073709551616::UHUGEINT AS k, (n::UHUGEINT * {hashing.M64}::UHUGEINT) % 18446744073709551616::UHUGEINT AS h0 FROM w),
k2 AS (SELECT *, (xor(k, k >> 47) * {hashing.M64}::UHUGEINT) % 18446744073709551616::UHUGEINT AS kk FROM k1),
h1 AS (SELECT *, CASE WHEN n >= 8 THEN (xor(h0, kk) * {hashing.M64}::UHUGEINT) % 18446744073709551616::UHUGEINT ELSE h0 END AS h FROM k2),
h2 AS (SELECT p_partkey, CASE WHEN n % 8 = 0 THEN h ELSE (xor(h, CASE WHEN n >= 8 THEN b ELSE a END) * {hashing.M64}::UHUGEINT) % 18446744073709551616::UHUGEINT END AS h FROM h1),
h3 AS (SELECT p_partkey, (xor(h, h >> 47) * {hashing.M64}::UHUGEINT) % 18446744073709551616::UHUGEINT AS h FROM h2)
SELECT p_partkey, xor(h, h >> 47)::DECIMAL(20,0) AS h FROM h3
"""


BYTES_AT = lambda at, n: " + ".join(f"CASE WHEN {i} < {n} THEN ('0x' || substr(x, (2 * ({at} + {i}) + 1)::INT, 2))::HUGEINT * {1 << 8 * i} ELSE 0 END" for i in range(4))
#: Of texts of up to 15 bytes.
MURMUR32_TEXT_SQL = f"""
WITH d AS (SELECT p_partkey, hex(encode(p_name)) || '00000000' AS x, octet_length(encode(p_name)) AS n FROM part),
w AS (SELECT p_partkey, n, {", ".join(f"CASE WHEN n >= {4 * i + 4} THEN {BYTES_AT(4 * i, 4)} END AS w{i}" for i in range(3))}, {BYTES_AT("n - n % 4", "n % 4")} AS t FROM d),
k AS (SELECT *, {", ".join(f"{MULTIPLIED(f'w{i}')} AS m{i}" for i in range(3))}, n::HUGEINT AS h FROM w),
l AS (SELECT *, {", ".join(f"{MULTIPLIED(f'xor(m{i}, m{i} >> 24)')} AS k{i}" for i in range(3))} FROM k),
h1 AS (SELECT * REPLACE (CASE WHEN n >= 4 THEN xor({MULTIPLIED("h")}, k0) ELSE h END AS h) FROM l), h2 AS (SELECT * REPLACE (CASE WHEN n >= 8 THEN xor({MULTIPLIED("h")}, k1) ELSE h END AS h) FROM h1),
h3 AS (SELECT * REPLACE (CASE WHEN n >= 12 THEN xor({MULTIPLIED("h")}, k2) ELSE h END AS h) FROM h2), h4 AS (SELECT * REPLACE (CASE WHEN n % 4 > 0 THEN {MULTIPLIED("xor(h, t)")} ELSE h END AS h) FROM h3),
h5 AS (SELECT p_partkey, {MULTIPLIED("xor(h, h >> 13)")} AS h FROM h4) SELECT p_partkey, xor(h, h >> 15)::BIGINT AS h FROM h5
"""


@query(MURMUR32_TEXT_SQL)
def murmur2_32_text(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", hashing.murmur32_binary(F.encode("p_name", "utf-8")).alias("h"))


@query()
def tabulation_text(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", as_decimal(hashing.tabulation_binary(F.encode(F.rpad("p_name", 32, " "), "utf-8"))).alias("h"))


@query(MURMUR_TEXT_SQL)
def murmur64a_text(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", as_decimal(hashing.murmur64a_binary(F.encode("p_name", "utf-8"))).alias("h"))


@query()
def tabulation_hash(spark, sf_dir):
    return order_sets(spark, sf_dir)[0].select("key", as_decimal(hashing.tabulation_hash("key")).alias("h"))


@query(" UNION ALL ".join(f"SELECT {i} AS seed, count(*) AS keys, count(DISTINCT h % 65536) AS distinct_hashes FROM {murmur_sql(ORDERS_SQL, s)}" for i, s in enumerate(hashing.SEEDS[:4])))
def hash_collision_rate(spark, sf_dir):
    return analytics.collision_rate(order_sets(spark, sf_dir)[0], 16, 4)


@query(f"SELECT {NTZ_SQL} AS ntz, count(*) AS n FROM {murmur_sql(ORDERS_SQL, 0)} GROUP BY ALL")
def trailing_zero_histogram(spark, sf_dir):
    return analytics.zero_histogram(order_sets(spark, sf_dir)[0])


# Exact sets


@query(f"({URGENT_SQL}) UNION ({HIGH_SQL})")
def set_union(spark, sf_dir):
    return sets.union(*two_sets(spark, sf_dir))


@query(f"({URGENT_SQL}) INTERSECT ({HIGH_SQL})")
def set_intersection(spark, sf_dir):
    return sets.intersection(*two_sets(spark, sf_dir))


@query(f"({URGENT_SQL}) EXCEPT ({HIGH_SQL})")
def set_difference(spark, sf_dir):
    return sets.difference(*two_sets(spark, sf_dir))


@query(BOTH_SQL)
def symmetric_difference(spark, sf_dir):
    return sets.symmetric_difference(*two_sets(spark, sf_dir))


@query(f"SELECT DISTINCT key FROM ({MEMBERS_SQL})")
def union_of_parties(spark, sf_dir):
    return sets.union_of_parties(memberships(spark, sf_dir))


@query(f"SELECT key, count(*) AS n FROM ({MEMBERS_SQL}) GROUP BY key HAVING count(*) < {PARTIES}")
def party_union_minus_intersection(spark, sf_dir):
    return sets.union_minus_intersection(memberships(spark, sf_dir), PARTIES)


@query(f"SELECT key FROM ({MEMBERS_SQL}) GROUP BY key HAVING count(*) = {PARTIES}")
def in_all_parties(spark, sf_dir):
    return sets.in_all(memberships(spark, sf_dir), PARTIES)


@query(f"SELECT key, count(*) AS n FROM ({MEMBERS_SQL}) GROUP BY key")
def party_counts(spark, sf_dir):
    return sets.multiplicities(memberships(spark, sf_dir))


@query(f"SELECT key, count(*) AS n, string_agg(party, ',' ORDER BY party) AS parties FROM ({MEMBERS_SQL}) GROUP BY key HAVING count(*) < {PARTIES}")
def partial_parties(spark, sf_dir):
    lists = sets.partial_parties(memberships(spark, sf_dir), PARTIES)
    return lists.select("key", F.size("parties").cast("long").alias("n"), said("parties").alias("parties"))


@query(MEMBERS_SQL)
def party_transform(spark, sf_dir):
    return sets.by_party(sets.parties_of(memberships(spark, sf_dir)))


@query(f"SELECT party, key FROM (SELECT unnest(range({PARTIES})) AS party, p_partkey AS key FROM part) WHERE {portable_sql('key || chr(47) || party', 7)} / 1152921504606846976.0::DOUBLE < 0.3")
def bernoulli_assignment(spark, sf_dir):
    return sets.assign(sets.key_set(table(spark, sf_dir, "part"), "p_partkey"), PARTIES, 0.3, 7)


NUMBERED_SQL = "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS number, c_custkey AS key FROM customer"


def numbered_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gossip.numbered(table(spark, sf_dir, "customer"), "c_custkey")


@query(f"SELECT unnest(range(3)) AS party, key FROM ({NUMBERED_SQL}) WHERE number < 50 UNION ALL SELECT (number - 50) // 20 AS party, key FROM ({NUMBERED_SQL}) WHERE number >= 50 AND number < 110")
def sample_key_sets(spark, sf_dir):
    return sets.shared_and_distinct(numbered_customers(spark, sf_dir), 50, 20, 3)


@query(f"SELECT number AS party, key FROM ({NUMBERED_SQL})")
def key_to_node(spark, sf_dir):
    return sets.key_to_node(numbered_customers(spark, sf_dir))


@query("SELECT 5000::BIGINT AS n, 5000::BIGINT AS n_distinct")
def generated_keys(spark, sf_dir):
    return sets.distinct_keys(spark, 5000, 3).agg(F.count("*").alias("n"), F.countDistinct("key").alias("n_distinct"))


ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789 "


@query(f"SELECT id AS pos, substr('{ALPHABET}', ({portable_sql('id', 5)} % 63 + 1)::INT, 1) AS byte FROM range(10000) t(id)")
def generated_text(spark, sf_dir):
    return sets.random_text(spark, 10000, 5)


# Many parties

MULTI = iblt.Spec(200, 4, "portable")
#: With room for cells that hold one key.
ROOMY = iblt.Spec(8000, 4, "portable")
MASK = (1 << multiparty.HASH_BITS) - 1


def nits_sql(coefficient: str, spec: iblt.Spec = MULTI) -> str:
    places = ", ".join(f"({portable_sql('key', i + 1)} % {spec.per_sub})::INT AS c{i}" for i in range(spec.k))
    rows = " UNION ALL ".join(f"SELECT {i} AS sub, c{i} AS cell, key, chk, v FROM p" for i in range(spec.k))
    return f"""
    WITH s AS (SELECT key, {coefficient} AS v FROM ({MEMBERS_SQL})), p AS (SELECT key, v, {portable_sql("key", 0)} & {MASK} AS chk, {places} FROM s), r AS ({rows}),
    b AS (SELECT *, unnest(range(32))::INT AS nit FROM r),
    n AS (SELECT sub, cell, 'key' AS kind, nit, v FROM b WHERE (key >> nit) & 1 = 1 UNION ALL SELECT sub, cell, 'hash', nit, v FROM b WHERE (chk >> nit) & 1 = 1 UNION ALL SELECT sub, cell, 'count', 0, v FROM r),
    t AS (SELECT sub, cell, kind, nit, (sum(v) % {PARTIES})::BIGINT AS v FROM n GROUP BY ALL) SELECT * FROM t WHERE v <> 0
    """


@query(nits_sql("1"))
def multi_nits(spark, sf_dir):
    return multiparty.build(memberships(spark, sf_dir), MULTI, PARTIES)


@query(nits_sql("3"))
def multi_scale(spark, sf_dir):
    return multiparty.scale(multiparty.build(memberships(spark, sf_dir), MULTI, PARTIES), 3, PARTIES)


@query(nits_sql("CASE WHEN party = 0 THEN 4 ELSE 1 END"))
def multi_subtract(spark, sf_dir):
    """All parties' tables but the first one's, minus that one."""
    m = memberships(spark, sf_dir)
    own, others = (multiparty.build(x, MULTI, PARTIES) for x in (m.where("party = 0"), m.where("party > 0")))
    return multiparty.subtract(others, own, PARTIES)


@query(
    f"""SELECT sub, cell, coalesce(bit_or(CASE WHEN kind = 'key' THEN 1::BIGINT << nit END), 0)::BIGINT AS key, max(v) AS c FROM ({nits_sql("1", ROOMY)}) GROUP BY sub, cell
    HAVING min(v) = max(v) AND count(*) FILTER (kind = 'count') = 1"""
)
def multi_divisible_cells(spark, sf_dir):
    return multiparty.divisible(multiparty.build(memberships(spark, sf_dir), ROOMY, PARTIES)).select("sub", "cell", "key", "c")


@query(f"SELECT key, count(*) AS parties FROM ({MEMBERS_SQL}) GROUP BY key HAVING count(*) < {PARTIES}")
def multi_decode(spark, sf_dir):
    m = settled(memberships(spark, sf_dir))
    found = multiparty.reconcile(m, PARTIES, max(80, m.select("key").distinct().count()))
    return found.select("key", F.col("coefficient").alias("parties"))


@query(ORACLES["multi_decode"])
def multi_decode_rounds(spark, sf_dir):
    """The same by rounds over the cluster, through a table sized by an estimate."""
    found = peeling.reconcile(memberships(spark, sf_dir), PARTIES)
    return found.select("key", F.col("coefficient").alias("parties"))


def said(parties: str) -> Column:
    return F.array_join(F.transform(parties, lambda p: p.cast("string")), ",")


@query(ORACLES["partial_parties"])
def multi_decode_holders(spark, sf_dir):
    """Who has the keys, from the tables' party bits."""
    found = peeling.reconcile(memberships(spark, sf_dir), PARTIES, holders=True)
    return found.select("key", F.col("coefficient").alias("n"), said("parties").alias("parties"))


#: Three overlapping collections of texts.
COLLECTIONS = ("n_chars < 3000", "n_chars > 700", "doc_id % 4 <> 0")
COLLECTED_SQL = " UNION ".join(f"SELECT {k} AS party, sha1(text) AS key FROM documents WHERE text IS NOT NULL AND {x}" for k, x in enumerate(COLLECTIONS))


@query(f"SELECT key, count(*) AS n, string_agg(party, ',' ORDER BY party) AS parties FROM ({COLLECTED_SQL}) GROUP BY key HAVING count(*) < 3")
def multi_decode_strings(spark, sf_dir):
    """The texts that some but not all of three collections have, by tables of 20-byte digests."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "n_chars", F.unhex(F.sha1(F.encode("text", "utf-8"))).alias("key"))
    has = F.filter(F.array(*(F.when(F.expr(x), F.lit(k)) for k, x in enumerate(COLLECTIONS))), lambda p: p.isNotNull())
    found = peeling.reconcile(docs.select("key", F.explode(has).alias("party")), 3, 160, holders=True)
    return found.select(F.lower(F.hex("key")).alias("key"), F.col("coefficient").alias("n"), said("parties").alias("parties"))


@query(
    f"""WITH p AS (SELECT 1::BIGINT << party AS bit, {", ".join(f"({portable_sql('key', i + 1)} % {MULTI.per_sub})::INT AS c{i}" for i in range(MULTI.k))} FROM ({MEMBERS_SQL})),
    r AS ({" UNION ALL ".join(f"SELECT {i} AS sub, c{i} AS cell, bit FROM p" for i in range(MULTI.k))}) SELECT sub, cell, bit_xor(bit) AS party_bits FROM r GROUP BY ALL"""
)
def multi_party_bits(spark, sf_dir):
    return multiparty.party_bits(memberships(spark, sf_dir), MULTI)


@query(nits_sql("1"))
def multi_wire_roundtrip(spark, sf_dir):
    sums = multiparty.build(memberships(spark, sf_dir), MULTI, PARTIES).withColumn("one", F.lit(1))
    return multiparty.from_wire(multiparty.to_wire(sums, "one"), "one").drop("one")


@query(ORACLES["multi_party_bits"])
def multi_extended_wire_roundtrip(spark, sf_dir):
    """Each party's own bucket bits, moved to its place, added up, written and read."""
    m = memberships(spark, sf_dir)
    bits = None
    for party in range(PARTIES):
        own = multiparty.party_bits(m.where(F.col("party") == party).withColumn("party", F.lit(0)), MULTI)
        own = own.select("sub", "cell", multiparty.at_party(F.col("party_bits"), party).alias("party_bits"))
        bits = own if bits is None else bits.unionByName(own)
    bits = bits.groupBy("sub", "cell").agg(F.bit_xor("party_bits").alias("party_bits"))
    return multiparty.extended_from_wire(multiparty.extended_to_wire(bits, PARTIES))


SHORT_SQL, LONG_SQL = (f"SELECT DISTINCT sha1(text) AS key FROM documents WHERE n_chars {x}" for x in ("< 1500", "> 1200"))


@query(f"SELECT 'A' AS side, key FROM (({SHORT_SQL}) EXCEPT ({LONG_SQL})) UNION ALL SELECT 'B' AS side, key FROM (({LONG_SQL}) EXCEPT ({SHORT_SQL}))")
def string_decode(spark, sf_dir):
    """The different ones of two sets of 40-byte strings."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    keys = lambda rows: rows.select(F.encode(F.sha1(F.encode("text", "utf-8")), "utf-8").alias("key")).distinct()
    found = strings.reconcile(keys(docs.where("n_chars < 1500")), keys(docs.where("n_chars > 1200")), 40)
    return found.select("side", F.decode("key", "utf-8").alias("key"))


@query(
    """WITH k AS (SELECT p_partkey, p_partkey AS a, p_size::BIGINT AS b FROM part),
    n AS (SELECT p_partkey, a, b, [(((a >> i) & 1) * 3 + ((b >> i) & 1)) % 5 FOR i IN range(32)] AS v FROM k)
    SELECT p_partkey, list_sum(v)::BIGINT AS total, len(list_filter(v, lambda x: x <> 0 AND x <> 3)) = 0 AS one_key, (a | b) AS key, len(list_filter(v, lambda x: x <> 0)) = 0 AS empty, (a * 1000003) % 1000000007 AS residue FROM n"""
)
def field_arithmetic(spark, sf_dir):
    """Three times one key plus another, bit by bit modulo 5."""
    keys = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("b"))
    v = field.added(field.multiplied(field.nits(F.col("p_partkey"), 32), 3, 5), field.nits(F.col("b"), 32), 5)
    rows = keys.select("p_partkey", v.alias("v"))
    total = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select(
        "p_partkey", total.alias("total"), field.holds_only(F.col("v"), F.lit(3)).alias("one_key"), field.key_of(F.col("v")).alias("key"), field.is_empty(F.col("v")).alias("empty"),
        field.scaled(F.col("p_partkey"), 1000003, 1_000_000_007).alias("residue"),
    )


NAME_BYTES = 40
LANES_SQL = ", ".join(f"('0x' || substr(x, {8 * i + 1}, 8))::BIGINT AS l{i}" for i in range(NAME_BYTES // 4))


@query(
    f"""WITH k AS (SELECT DISTINCT rpad(left(p_name, {NAME_BYTES}), {NAME_BYTES}, ' ') AS key FROM part), d AS (SELECT hex(encode(key)) AS x, ('0x' || substr(md5(key), 1, 15))::BIGINT AS number FROM k),
    p AS (SELECT {LANES_SQL}, {", ".join(f"({portable_sql('number', i + 1)} % {MULTI.per_sub})::INT AS c{i}" for i in range(MULTI.k))} FROM d),
    r AS ({" UNION ALL ".join(f"SELECT {i} AS sub, c{i} AS cell, {j} AS lane, l{j} AS v FROM p" for i in range(MULTI.k) for j in range(NAME_BYTES // 4))})
    SELECT sub, cell, lane, bit_xor(v) AS v FROM r GROUP BY ALL"""
)
def string_key_xor(spark, sf_dir):
    keys = table(spark, sf_dir, "part").select(F.encode(F.rpad(F.substring("p_name", 1, NAME_BYTES), NAME_BYTES, " "), "utf-8").alias("key")).distinct()
    return multiparty.string_lanes(keys, MULTI, NAME_BYTES)


# Fingerprints

AVERAGE = 50
BYTES_SQL = "SELECT doc_id, octet_length(encode(text)) AS n, unnest(regexp_extract_all(hex(encode(text)), '(..)')) AS x, generate_subscripts(regexp_extract_all(hex(encode(text)), '(..)'), 1) AS pos FROM {source}"
TERMS_SQL = " + ".join(f"coalesce(lag(b, {j}) OVER w, 0) * {pow(fingerprint.BASE, j, 1 << 32)}" for j in range(fingerprint.TERMS))


def hashes_sql(source: str = "documents") -> str:
    return f"""SELECT doc_id, n, pos, ({TERMS_SQL}) & 4294967295 AS h FROM (SELECT doc_id, n, pos, (('0x' || x)::INT - CASE WHEN ('0x' || x)::INT > 127 THEN 256 ELSE 0 END)::BIGINT AS b
    FROM ({BYTES_SQL.format(source=source)})) WINDOW w AS (PARTITION BY doc_id ORDER BY pos)"""


def winnow_sql(source: str = "documents", average: int = AVERAGE) -> str:
    window = 2 * average - 1
    return f"""SELECT DISTINCT doc_id, 2147483647 - (c & 2147483647) AS pos, c >> 31 AS h FROM (SELECT doc_id, min((h << 31) + 2147483647 - pos) OVER (PARTITION BY doc_id ORDER BY pos ROWS {window - 1} PRECEDING) AS c
    FROM ({hashes_sql(source)}) WHERE pos <= n - {window} - 1)"""


@query(f"SELECT doc_id, count(*) AS n, sum(h)::BIGINT AS hash_sum, bit_xor(h) AS hash_xor, min(h) AS hash_min, max(h) AS hash_max FROM ({hashes_sql()}) GROUP BY doc_id")
def rolling_hash(spark, sf_dir):
    return fingerprint.hash_summary(table(spark, sf_dir, "documents"))


@query(winnow_sql())
def winnow(spark, sf_dir):
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"), AVERAGE)


@query(f"SELECT doc_id, pos - 1 AS pos, h FROM ({hashes_sql()}) WHERE h % {AVERAGE} = 0")
def mod_sampling(spark, sf_dir):
    return fingerprint.samples(table(spark, sf_dir, "documents"), AVERAGE)


@query(f"SELECT d.doc_id, count(h) AS n_fp, octet_length(encode(any_value(text)))::BIGINT AS n_bytes FROM documents d LEFT JOIN ({winnow_sql()}) f ON d.doc_id = f.doc_id GROUP BY d.doc_id")
def fingerprint_density(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    counts = fingerprint.fingerprints(docs, AVERAGE).groupBy("doc_id").agg(F.count("*").alias("n_fp"))
    return docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes")).join(counts, "doc_id", "left").select("doc_id", F.coalesce("n_fp", F.lit(0)).cast("long").alias("n_fp"), "n_bytes")


def digests_sql(source: str = "documents", overlap: int = 0) -> str:
    return f"""(WITH f AS ({winnow_sql(source)}), d AS (SELECT doc_id, hex(encode(text)) AS x, octet_length(encode(text))::BIGINT AS n FROM {source}),
    e AS (SELECT doc_id, pos AS stop FROM f UNION SELECT doc_id, n FROM d WHERE n > 0), s AS (SELECT doc_id, stop, coalesce(lag(stop) OVER w, 0) AS start, row_number() OVER w - 1 AS block_no FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY stop))
    SELECT s.doc_id, block_no, start, stop - start AS len, ('0x' || substr(md5(substr(x, 2 * start + 1, 2 * (stop - start + CASE WHEN stop < n THEN {overlap} ELSE 0 END))), 1, 15))::BIGINT AS h FROM s JOIN d ON s.doc_id = d.doc_id)"""


@query(f"SELECT * FROM {digests_sql()}")
def block_digest(spark, sf_dir):
    return fingerprint.digests(table(spark, sf_dir, "documents"), AVERAGE)


@query(f"SELECT h, count(DISTINCT block) AS n FROM (SELECT g.h, substr(hex(encode(text)), 2 * start + 1, 2 * len) AS block FROM {digests_sql()} g JOIN documents d ON g.doc_id = d.doc_id) GROUP BY h HAVING count(DISTINCT block) > 1")
def digest_collisions(spark, sf_dir):
    return fingerprint.collisions(table(spark, sf_dir, "documents"), AVERAGE)


PAIRS_SQL = "SELECT lag(doc_id) OVER (PARTITION BY lang, source ORDER BY doc_id) AS d1, doc_id AS d2 FROM documents QUALIFY d1 IS NOT NULL"


def document_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and the one before it of the same language and source."""
    before = F.lag("doc_id").over(Window.partitionBy("lang", "source").orderBy("doc_id"))
    return table(spark, sf_dir, "documents").select(before.alias("d1"), F.col("doc_id").alias("d2")).where("d1 is not null")


def jaccard_sql(hashes: str) -> str:
    return f"""WITH p AS ({PAIRS_SQL}), f AS (SELECT DISTINCT doc_id, h FROM {hashes}), e AS (SELECT d1, d2, h, 1 AS side FROM p JOIN f ON d1 = doc_id UNION ALL SELECT d1, d2, h, 2 FROM p JOIN f ON d2 = doc_id),
    s AS (SELECT d1, d2, h, sum(side) AS sides FROM e GROUP BY ALL) SELECT d1, d2, count(*) FILTER (sides = 3) AS inter, count(*) AS uni FROM s GROUP BY ALL"""


@query(jaccard_sql(f"({winnow_sql()})"))
def fingerprint_jaccard(spark, sf_dir):
    return fingerprint.jaccard(document_pairs(spark, sf_dir), fingerprint.fingerprint_sets(table(spark, sf_dir, "documents"), AVERAGE))


@query(jaccard_sql(digests_sql()))
def digest_jaccard(spark, sf_dir):
    return fingerprint.jaccard(document_pairs(spark, sf_dir), fingerprint.digest_sets(table(spark, sf_dir, "documents"), AVERAGE))


def classes_sql(hashes: str, percent: int = 80) -> str:
    """f: elements, r: each document's class by its list of elements."""
    return f"""WITH f AS (SELECT DISTINCT doc_id, h FROM ({hashes})), l AS (SELECT doc_id, list(h ORDER BY h) AS hs FROM f GROUP BY doc_id), r AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY hs) AS rep, len(hs) AS n FROM l)"""


def similar_sql(hashes: str, percent: int = 80) -> str:
    return f"""{classes_sql(hashes)}, k AS (SELECT * FROM r WHERE doc_id = rep), e AS (SELECT f.* FROM f JOIN k USING (doc_id)),
    p AS (SELECT x.doc_id AS d1, y.doc_id AS d2, count(*) AS inter FROM e x JOIN e y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY ALL)
    SELECT d1, d2, inter, a.n + b.n - inter AS uni FROM p JOIN k a ON a.doc_id = d1 JOIN k b ON b.doc_id = d2 WHERE 100 * inter >= {percent} * (a.n + b.n - inter)"""


@query(similar_sql(winnow_sql()))
def similar_documents(spark, sf_dir):
    """All pairs of documents whose fingerprints are similar; copies are one class."""
    return similar.similar_pairs(fingerprint.fingerprints(table(spark, sf_dir, "documents"), AVERAGE), 80)[0]


@query(f"{classes_sql(winnow_sql())} SELECT doc_id, rep FROM r")
def similar_classes(spark, sf_dir):
    return similar.similar_pairs(fingerprint.fingerprints(table(spark, sf_dir, "documents"), AVERAGE), 80)[1]


@query(similar_sql(f"SELECT doc_id, h FROM {digests_sql()}", 50))
def similar_digests(spark, sf_dir):
    """The same by the hashes of their blocks, at a lower similarity."""
    return similar.similar_pairs(fingerprint.digests(table(spark, sf_dir, "documents"), AVERAGE), 50)[0]


REACH = 200
TWO_WAY_SQL = f"""
SELECT doc_id, pos, h FROM (SELECT *, min((h << 31) + pos) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {REACH} PRECEDING AND {REACH} FOLLOWING) AS least FROM ({hashes_sql()}))
WHERE pos > {REACH} AND pos <= n - {REACH} AND least = (h << 31) + pos
"""


@query(
    f"""WITH d AS (SELECT doc_id, hex(encode(text)) AS x, octet_length(encode(text))::BIGINT AS n FROM documents), e AS (SELECT doc_id, pos AS stop FROM ({TWO_WAY_SQL}) UNION SELECT doc_id, n FROM d WHERE n > 0),
    s AS (SELECT doc_id, stop, coalesce(lag(stop) OVER w, 0) AS start, row_number() OVER w - 1 AS block_no FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY stop))
    SELECT s.doc_id, block_no, start, stop - start AS len, ('0x' || substr(md5(substr(x, 2 * start + 1, 2 * (stop - start))), 1, 15))::BIGINT AS h FROM s JOIN d ON s.doc_id = d.doc_id"""
)
def two_way_chunks(spark, sf_dir):
    """Blocks cut where a rolling hash is the least of both neighbourhoods."""
    return fingerprint.digests(table(spark, sf_dir, "documents"), REACH, cuts=fingerprint.two_way_minimum)


@query(f"SELECT count(DISTINCT h) AS hashes, count(*) AS fingerprints FROM ({winnow_sql()})")
def distinct_fingerprints(spark, sf_dir):
    found = fingerprint.fingerprints(table(spark, sf_dir, "documents"), AVERAGE)
    return found.agg(F.countDistinct("h").alias("hashes"), F.count("*").alias("fingerprints"))


# File and directory synchronisation: each document against a version in which some words are written in capitals

EDITED_SQL = "(SELECT doc_id, replace(replace(text, ' the on', ' THE ON'), ' de la', ' DE LA') AS text FROM documents)"
OVERLAP = 1


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    old = table(spark, sf_dir, "documents").select("doc_id", "text")
    edited = F.replace(F.replace("text", F.lit(" the on"), F.lit(" THE ON")), F.lit(" de la"), F.lit(" DE LA"))
    return old, old.select("doc_id", edited.alias("text"))


def both_digests(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The blocks of both versions; a plan reads them once."""
    return [fingerprint.digests(x, AVERAGE, OVERLAP) for x in versions(spark, sf_dir)]


@query(
    f"""WITH o AS {digests_sql("documents", OVERLAP)}, n AS {digests_sql(EDITED_SQL, OVERLAP)}, k AS (SELECT doc_id, h, len, row_number() OVER (PARTITION BY doc_id ORDER BY h, len) - 1 AS rank FROM (SELECT DISTINCT doc_id, h, len FROM o)),
    j AS (SELECT n.*, k.rank, k.rank IS NOT NULL AS "exists" FROM n LEFT JOIN k ON n.doc_id = k.doc_id AND n.h = k.h AND n.len = k.len),
    s AS (SELECT doc_id, h, len, row_number() OVER (PARTITION BY doc_id ORDER BY h, len) - 1 AS near FROM (SELECT DISTINCT doc_id, h, len FROM j WHERE "exists")),
    l AS (SELECT *, "exists" AND coalesce(lag("exists") OVER (PARTITION BY doc_id ORDER BY block_no), false) AS local FROM j)
    SELECT l.doc_id, block_no, start, l.len, "exists", local, CASE WHEN local THEN near WHEN "exists" THEN rank END AS ref FROM l LEFT JOIN s ON l.doc_id = s.doc_id AND l.h = s.h AND l.len = s.len"""
)
def file_sync_plan(spark, sf_dir):
    return filesync.sync_plan(*both_digests(spark, sf_dir))


@query(
    f"""SELECT doc_id, sum(CASE WHEN "exists" THEN 0 ELSE len END)::BIGINT AS literal_bytes, (16 * count(*) FILTER ("exists") + 2 * count(*))::BIGINT AS reference_bits,
    (sum(CASE WHEN "exists" THEN 0 ELSE len END) + ceil((16 * count(*) FILTER ("exists") + 2 * count(*)) / 8.0))::BIGINT AS plan_bytes FROM ({ORACLES["file_sync_plan"]}) GROUP BY doc_id"""
)
def file_sync_bytes(spark, sf_dir):
    return filesync.sync_bytes(filesync.sync_plan(*both_digests(spark, sf_dir)))


# The protocol, with the block size of files of less than 490,000 bytes and the overlap that goes with it

OVERLAP_SQL = f"(CASE WHEN n // {filesync.LEAST_BLOCK} >= 256 THEN 2 ELSE 1 END)"


def named_blocks_sql(source: str = "documents") -> str:
    """(doc_id, block_no, start, len, key, head, block): bytes in hex."""
    return f"""(WITH f AS ({winnow_sql(source, filesync.LEAST_BLOCK)}), d AS (SELECT doc_id, hex(encode(text)) AS x, octet_length(encode(text))::BIGINT AS n FROM {source}),
    e AS (SELECT doc_id, pos AS stop FROM f UNION SELECT doc_id, n FROM d WHERE n > 0), s AS (SELECT doc_id, stop, coalesce(lag(stop) OVER w, 0) AS start, row_number() OVER w - 1 AS block_no FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY stop)),
    c AS (SELECT s.doc_id, block_no, start, stop - start AS len, substr(x, 2 * start + 1, 2 * (stop - start + {OVERLAP_SQL})) AS covered, substr(x, 2 * start + 1, 2 * (stop - start)) AS block, {OVERLAP_SQL} AS overlap FROM s JOIN d ON s.doc_id = d.doc_id)
    SELECT doc_id, block_no, start, len, ('0x' || substr(md5(covered || ':' || len), 1, 15))::BIGINT AS key, substr(covered, 1, 2 * overlap) AS head, block FROM c)"""


def synchronised(spark: SparkSession, sf_dir: str, octets: bool = False) -> tuple[DataFrame, DataFrame]:
    """(files, what both sides tell each other) of the two versions."""
    files = settled(protocol.paired(*versions(spark, sf_dir)))
    return files, settled(protocol.exchanged(files, octets=octets))


@query(
    f"""WITH o AS (SELECT DISTINCT doc_id, key FROM {named_blocks_sql()}), n AS (SELECT DISTINCT doc_id, key FROM {named_blocks_sql(EDITED_SQL)})
    SELECT doc_id, 'A' AS side, key FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT doc_id, 'B' AS side, key FROM (SELECT * FROM o EXCEPT SELECT * FROM n)"""
)
def file_sync_decode(spark, sf_dir):
    """Each file's different keys, by estimators and tables of all files."""
    return protocol.differences(synchronised(spark, sf_dir)[1])


ROUND2_SQL = f"""
WITH o AS (SELECT DISTINCT doc_id, key FROM {named_blocks_sql()}), b AS (SELECT * FROM {named_blocks_sql(EDITED_SQL)}), n AS (SELECT doc_id, key, arg_min(head, block_no) AS head FROM b GROUP BY ALL),
k AS (SELECT o.doc_id, o.key, head, n.key IS NOT NULL AS shared, row_number() OVER (PARTITION BY o.doc_id ORDER BY o.key) - 1 AS place FROM o LEFT JOIN n ON o.doc_id = n.doc_id AND o.key = n.key),
g AS (SELECT doc_id, key, row_number() OVER (PARTITION BY doc_id, head ORDER BY key) - 1 AS near FROM k WHERE shared),
j AS (SELECT b.*, place, place IS NOT NULL AS known FROM b LEFT JOIN k ON b.doc_id = k.doc_id AND b.key = k.key),
l AS (SELECT *, coalesce(lag(known) OVER (PARTITION BY doc_id ORDER BY block_no), false) AS before FROM j),
m AS (SELECT l.*, CASE WHEN before THEN near ELSE place END AS ref FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.key = g.key),
said AS (SELECT doc_id, string_agg(CASE WHEN known THEN '1' ELSE '0' END, '' ORDER BY block_no) AS chunk_exists, string_agg(CASE WHEN known THEN ref::VARCHAR END, ',' ORDER BY block_no) AS existing,
    string_agg(CASE WHEN known THEN NULL ELSE block END, '' ORDER BY block_no) AS new FROM m GROUP BY doc_id),
heard AS (SELECT doc_id, string_agg(CASE WHEN shared THEN '1' ELSE '0' END, '' ORDER BY key) AS hash_exists FROM k GROUP BY doc_id)
SELECT e.doc_id, coalesce(chunk_exists, '') AS chunk_exists, coalesce(hash_exists, '') AS hash_exists, coalesce(existing, '') AS existing, md5(coalesce(new, '')) AS new_md5, sha1(text) AS sha1
FROM {EDITED_SQL} e LEFT JOIN said ON e.doc_id = said.doc_id LEFT JOIN heard ON e.doc_id = heard.doc_id
"""


@query(ROUND2_SQL)
def file_sync_round2(spark, sf_dir):
    """What the sender says of each file, after it was encoded and decoded, as text."""
    bits = lambda c: F.array_join(F.transform(c, lambda x: F.when(x, "1").otherwise("0")), "")
    _, told = synchronised(spark, sf_dir)
    return protocol.received(protocol.encoded(told)).select(
        "doc_id", bits("chunk_exists").alias("chunk_exists"), bits("hash_exists").alias("hash_exists"), F.array_join(F.transform("existing_chunk_encoding", lambda x: x.cast("string")), ",").alias("existing"),
        F.md5(F.encode(F.array_join(F.transform("new_chunk_info", lambda x: F.hex(x)), ""), "utf-8")).alias("new_md5"), F.lower(F.hex("sha1")).alias("sha1"),
    )


@query(f"SELECT doc_id, sha1(text) AS sha1, true AS ok FROM {EDITED_SQL}")
def file_sync_rebuilt(spark, sf_dir):
    """Each file's new version, as the receiver puts it together."""
    files, told = synchronised(spark, sf_dir)
    return protocol.rebuilt(files, protocol.received(protocol.encoded(told))).select("doc_id", F.sha1("content").alias("sha1"), "ok")


@query(
    f"""SELECT doc_id, (length(chunk_exists) + length(hash_exists) + 32 * CASE WHEN existing = '' THEN 0 ELSE len(string_split(existing, ',')) END + 8 * new_bytes)::BIGINT AS round2_bits
    FROM ({ROUND2_SQL.replace("md5(coalesce(new, '')) AS new_md5", "length(coalesce(new, '')) // 2 AS new_bytes")})"""
)
def file_sync_round2_bits(spark, sf_dir):
    return synchronised(spark, sf_dir)[1].select("doc_id", protocol.round2_bits().alias("round2_bits"))


def varint_sql(x: str) -> str:
    """The octets that a number from 0 takes."""
    return "(1 + " + " + ".join(f"(({x}) >= {1 << 7 * k})::INT" for k in range(1, 9)) + ")"


def framed_sql(*octets: str) -> str:
    """The octets of parts, each behind its length."""
    return " + ".join(f"({x}) + {varint_sql(x)}" for x in octets)


ROUND2_OCTETS_SQL = ROUND2_SQL.replace(
    "ORDER BY block_no) AS new FROM m", f"ORDER BY block_no) AS new, sum(CASE WHEN NOT known THEN {varint_sql('len')} END) AS lengths, sum(CASE WHEN known THEN {varint_sql('ref')} END) AS places FROM m"
).replace("md5(coalesce(new, '')) AS new_md5", "length(coalesce(new, '')) // 2 AS new_bytes, coalesce(lengths, 0)::BIGINT AS lengths, coalesce(places, 0)::BIGINT AS places")


CELLS_OCTETS_SQL = f"""
WITH c AS ({cells_sql(f"SELECT o_custkey AS key, 1 AS sign FROM (SELECT DISTINCT o_custkey FROM orders)", iblt.Spec(4000, 4, "portable"))}),
s AS (SELECT *, sub * 1000 + cell - coalesce(lag(sub * 1000 + cell) OVER (ORDER BY sub, cell), -1) - 1 AS step FROM c),
o AS (SELECT {", ".join(f"sum({varint_sql(x)})::BIGINT AS {n}" for n, x in (("steps", "step"), ("keys", "key_sum"), ("checks", "hash_sum"), ("counts", "2 * cnt")))} FROM s)
SELECT 0::BIGINT AS segment, ({framed_sql("steps", "keys", "checks", "counts")})::BIGINT AS octets FROM o
"""


@query(CELLS_OCTETS_SQL)
def iblt_codec_octets(spark, sf_dir):
    spec = iblt.Spec(4000, 4, "portable")
    keys = sets.key_set(table(spark, sf_dir, "orders"), "o_custkey")
    return codec.packed(iblt.build(keys, spec), spec).select("segment", F.octet_length("octets").cast("long").alias("octets"))


@query(
    f"""WITH r AS ({ROUND2_OCTETS_SQL}), n AS (SELECT *, length(chunk_exists) AS chunks, length(hash_exists) AS hashes FROM r)
    SELECT doc_id, ({framed_sql(f"{varint_sql('chunks')} + {varint_sql('hashes')}", "(chunks + 7) // 8", "(hashes + 7) // 8", "places", "lengths", "new_bytes", "20")})::BIGINT AS octets FROM n"""
)
def file_sync_round2_octets(spark, sf_dir):
    return protocol.encoded(synchronised(spark, sf_dir)[1]).select("doc_id", F.octet_length("octets").cast("long").alias("octets"))


@query()
def file_sync_totals(spark, sf_dir):
    """The octets that are sent, as they are and by zlib, against compressed whole files; sizes of estimators, of tables and by zlib aren't SQL's."""
    return protocol.totals(*synchronised(spark, sf_dir, octets=True))


@query(f"SELECT doc_id, sha1(text) AS sha1 FROM {EDITED_SQL} WHERE text <> ''")
def file_reconstruct(spark, sf_dir):
    old, new = versions(spark, sf_dir)
    return filesync.reconstructed(old, new, AVERAGE, OVERLAP)


@query("SELECT doc_id, sha1(text) AS sha1 FROM documents")
def zlib_roundtrip(spark, sf_dir):
    packed = filesync.compressed(F.encode("text", "utf-8"))
    return in_small_batches(table(spark, sf_dir, "documents")).select("doc_id", F.sha1(filesync.decompressed(packed)).alias("sha1"))


@query("SELECT doc_id, greatest(700, floor(sqrt(n)))::BIGINT AS block, greatest(1, floor(ln(greatest(n // greatest(700, floor(sqrt(n))), 1)) / ln(256)) + 1)::INT AS overlap FROM (SELECT doc_id, octet_length(encode(text)) AS n FROM documents)")
def block_size_rule(spark, sf_dir):
    n = F.octet_length("text")
    block = filesync.block_size(n)
    return table(spark, sf_dir, "documents").select("doc_id", block.alias("block"), filesync.overlap_of(n, block).alias("overlap"))


BYTES_HEX_SQL = "SELECT doc_id, generate_subscripts(regexp_extract_all(hex(encode(text)), '(..)'), 1) - 1 AS pos, ('0x' || unnest(regexp_extract_all(hex(encode(text)), '(..)')))::INT AS b FROM documents"
(DRAW_A, DRAW_B, DRAW_C), *DRAW_STEPS, DRAW_LAST = filesync.DRAW
DRAWN_SQL = f"((pos::HUGEINT * {DRAW_A} + (doc_id::HUGEINT * {DRAW_B} + {11 * DRAW_C}) % 4294967296) % 4294967296)"
for _shift, _times in DRAW_STEPS:
    DRAWN_SQL = f"((xor({DRAWN_SQL}, {DRAWN_SQL} >> {_shift}) * {_times}) % 4294967296)"
ONE_UP_SQL = "printf('%02X', (b + CASE WHEN hit THEN 1 ELSE 0 END) % 256)"


@query(
    f"""WITH x AS (SELECT doc_id, pos, b, {DRAWN_SQL} AS x FROM ({BYTES_HEX_SQL})), h AS (SELECT *, xor(x, x >> {DRAW_LAST}) < {int(0.001 * (1 << 32))} AS hit FROM x)
    SELECT doc_id, count(*) FILTER (hit) AS n_changed, md5(string_agg({ONE_UP_SQL}, '' ORDER BY pos)) AS content_md5 FROM h GROUP BY doc_id"""
)
def corrupt_random(spark, sf_dir):
    changed = filesync.similar_files(table(spark, sf_dir, "documents"), 0.001, 11)
    return changed.select("doc_id", "n_changed", F.md5(F.encode(F.hex("content"), "utf-8")).alias("content_md5"))


DRAWN_STARTS_SQL = ", ".join(f"floor({portable_sql('doc_id', 13 + k)} / 1152921504606846976.0::DOUBLE * greatest(n - 5, 1))::BIGINT" for k in range(5))


@query(
    f"""WITH RECURSIVE d AS (SELECT doc_id, octet_length(encode(text))::BIGINT AS n FROM documents WHERE text <> ''), s AS (SELECT DISTINCT doc_id, unnest([{DRAWN_STARTS_SQL}]) AS start FROM d),
    kept AS (SELECT doc_id, min(start) AS start FROM s GROUP BY doc_id UNION ALL SELECT k.doc_id, (SELECT min(s.start) FROM s WHERE s.doc_id = k.doc_id AND s.start >= k.start + 5) AS start FROM kept k WHERE k.start IS NOT NULL),
    h AS (SELECT b.doc_id, pos, b, count(k.start) > 0 AS hit FROM ({BYTES_HEX_SQL}) b LEFT JOIN kept k ON b.doc_id = k.doc_id AND pos >= k.start AND pos < k.start + 5 GROUP BY ALL),
    c AS (SELECT doc_id, count(start) AS n_blocks FROM kept GROUP BY doc_id)
    SELECT h.doc_id, any_value(n_blocks) AS n_blocks, md5(string_agg({ONE_UP_SQL}, '' ORDER BY pos)) AS content_md5 FROM h JOIN c ON h.doc_id = c.doc_id GROUP BY h.doc_id"""
)
def corrupt_blocks(spark, sf_dir):
    changed = filesync.block_changed_files(table(spark, sf_dir, "documents"), 5, 5, 13)
    return changed.select("doc_id", "n_blocks", F.md5(F.encode(F.hex("content"), "utf-8")).alias("content_md5"))


# The other side's directory: nets renamed, orgs in French modified, coms in German missing, and others' pages of its own
THEIRS_SQL = """SELECT CASE WHEN url LIKE '%.net/%' THEN url || '.old' ELSE url END AS path, CASE WHEN url LIKE '%.org/fr%' THEN html || '!' ELSE html END AS content FROM pages WHERE url NOT LIKE '%.com/de%'
UNION ALL SELECT url || '.extra', html || '?' FROM pages WHERE url LIKE '%.com/fr%'"""


@query(
    f"""WITH a AS (SELECT url AS path, sha1(html) AS a FROM pages), b AS (SELECT path, sha1(content) AS b FROM ({THEIRS_SQL})),
    h AS (SELECT a AS b, min(path) AS target FROM a GROUP BY a), o AS (SELECT b.path, CASE WHEN target IS NOT NULL THEN 'rename' ELSE 'delete' END AS action, target FROM b LEFT JOIN h ON b.b = h.b WHERE b.path NOT IN (SELECT path FROM a))
    SELECT * FROM o UNION ALL SELECT a.path, 'modified', NULL FROM a JOIN b ON a.path = b.path WHERE a <> b
    UNION ALL SELECT path, 'new', NULL FROM a WHERE path NOT IN (SELECT path FROM b) AND path NOT IN (SELECT target FROM o WHERE action = 'rename')"""
)
def dir_diff_plan(spark, sf_dir):
    return filesync.directory_plan(*manifests(spark, sf_dir))


@query(
    f"""WITH a AS (SELECT DISTINCT url AS path, sha1(html) AS c FROM pages), b AS (SELECT DISTINCT path, sha1(content) AS c FROM ({THEIRS_SQL}))
    SELECT 'A' AS side, path FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'B' AS side, path FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"""
)
def dir_difference(spark, sf_dir):
    """The entries that only one side has, by sketches of the manifests."""
    return reconcile_directories(*manifests(spark, sf_dir))


def shuffled_manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The pages by number, and a directory where, ten by ten, they are the same, go around in a circle, have moved on by one, or
    are partly missing, there twice or changed."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.sha1(F.encode("html", "utf-8")).alias("content_sha1"))
    k, kind = F.col("page_id") % 10, F.floor(F.col("page_id") / 10) % 4
    donor = F.when(kind == 1, F.col("page_id") - k + (k + 9) % 10).when((kind == 2) & (k < 9), F.col("page_id") + 1).when((kind == 3) & (k == 5), F.col("page_id") - 1).otherwise(F.col("page_id"))
    given = pages.select(F.col("page_id").alias("donor"), F.col("content_sha1").alias("given"))
    name = lambda c: F.concat(F.lit("page/"), F.col(c).cast("string")).alias("path")
    placed = pages.withColumn("donor", donor).join(given, "donor", "left").withColumn("content_sha1", F.coalesce("given", "content_sha1"))
    theirs = placed.where(~((kind == 3) & (k % 4 == 0))).withColumn("content_sha1", F.when((kind == 2) & (k == 9) | (kind == 3) & (k == 7), F.sha1(F.col("content_sha1"))).otherwise(F.col("content_sha1")))
    extra = pages.where((kind == 3) & (k == 8)).select(F.concat(F.lit("old/"), F.col("page_id").cast("string")).alias("path"), "content_sha1")
    return pages.select(name("page_id"), "content_sha1"), theirs.select(name("page_id"), "content_sha1").unionByName(extra)


@query("SELECT 'page/' || page_id AS path, sha1(html) AS content_sha1 FROM pages")
def dir_moves_applied(spark, sf_dir):
    """Their directory after the plan of renames, copies, fetches and deletions: it is mine."""
    mine, theirs = shuffled_manifests(spark, sf_dir)
    return moves.applied(theirs, moves.move_plan(mine, theirs))


def manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pages = table(spark, sf_dir, "pages")
    mine = pages.select(F.col("url").alias("path"), F.encode("html", "utf-8").alias("content"))
    changed = F.when(F.col("url").like("%.org/fr%"), F.concat("html", F.lit("!"))).otherwise(F.col("html"))
    moved = F.when(F.col("url").like("%.net/%"), F.concat("url", F.lit(".old"))).otherwise(F.col("url"))
    theirs = pages.where(~F.col("url").like("%.com/de%")).select(moved.alias("path"), F.encode(changed, "utf-8").alias("content"))
    extra = pages.where(F.col("url").like("%.com/fr%")).select(F.concat("url", F.lit(".extra")).alias("path"), F.encode(F.concat("html", F.lit("?")), "utf-8").alias("content"))
    return filesync.manifest(mine), filesync.manifest(theirs.unionByName(extra))


# Gossip: nations are nodes

NODES_SQL = "SELECT n_nationkey::BIGINT AS node FROM nation"
HALF_SQL = f"SELECT a.node AS src, b.node AS dst FROM ({NODES_SQL}) a JOIN ({NODES_SQL}) b ON a.node < b.node WHERE {portable_sql('a.node || chr(47) || b.node', 0)} / 1152921504606846976.0::DOUBLE < 0.12"
GRAPH_SQL = f"SELECT src, dst FROM ({HALF_SQL}) UNION ALL SELECT dst, src FROM ({HALF_SQL})"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("node"))


@query(f"SELECT a.node AS src, b.node AS dst FROM ({NODES_SQL}) a JOIN ({NODES_SQL}) b ON a.node <> b.node")
def gossip_complete(spark, sf_dir):
    return gossip.complete_network(nodes(spark, sf_dir))


@query(GRAPH_SQL)
def gossip_graph(spark, sf_dir):
    return gossip.random_network(nodes(spark, sf_dir), 0.12)


@query(
    f"""WITH RECURSIVE g AS ({GRAPH_SQL}), r(node, other) AS (SELECT node, node FROM ({NODES_SQL}) UNION SELECT r.node, g.dst FROM r JOIN g ON r.other = g.src)
    SELECT node, min(other) AS component FROM r GROUP BY node"""
)
def gossip_connected(spark, sf_dir):
    every = nodes(spark, sf_dir)
    return gossip.components(every, settled(gossip.random_network(every, 0.12)))


@query()
def gossip_rounds(spark, sf_dir):
    every = nodes(spark, sf_dir)
    state, rounds = gossip.run(every, gossip.connected_random_network(every))
    return gossip.received(state).withColumn("rounds", F.lit(rounds))


@query()
def gossip_retrieved(spark, sf_dir):
    """Messages: market segments' customer counts' keys, held by nearly all nations."""
    every = nodes(spark, sf_dir)
    state, _ = gossip.run(every, gossip.connected_random_network(every))
    keys = spark.range(200).select(F.col("id").alias("key"))
    held = settled(sets.assign(keys, every.count(), 0.98, 17).select(F.col("party").alias("node"), "key"))
    return gossip.transmitted(settled(gossip.retrieved(state, held, iblt.Spec(400, 4))), held, every.count())


# Analytics

def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("setting", F.floor(F.col("value") / 10).cast("long"))


@query("SELECT event_type, floor(value / 10)::BIGINT AS setting, round(avg(value), 6) AS mean FROM events WHERE floor(value / 10) BETWEEN 1 AND 8 GROUP BY ALL")
def group_means(spark, sf_dir):
    return analytics.group_means(runs(spark, sf_dir), "event_type", "setting", "value", 1, 8).withColumn("mean", F.round("mean", 6))


@query(
    """WITH m AS (SELECT event_type, floor(value / 10)::BIGINT AS setting, avg(value) AS mean FROM events WHERE floor(value / 10) BETWEEN 1 AND 8 GROUP BY ALL)
    SELECT event_type, arg_min(setting, mean) AS best, round(min(mean), 6) AS least FROM m GROUP BY event_type"""
)
def group_mean_argmin(spark, sf_dir):
    means = analytics.group_means(runs(spark, sf_dir), "event_type", "setting", "value", 1, 8)
    return analytics.best_setting(means, "event_type", "setting").withColumn("least", F.round("least", 6))


@query("SELECT event_type, round(quantile_cont(value, 0.999), 6) AS p FROM events GROUP BY event_type")
def percentile_999(spark, sf_dir):
    return analytics.high_percentile(table(spark, sf_dir, "events"), "event_type", "value").withColumn("p", F.round("p", 6))


@query("SELECT user_id, CASE WHEN k < 1 THEN 0 WHEN k < 2 THEN 1 WHEN k < 3 THEN 2 ELSE 3 END AS bin, count(*) AS n FROM (SELECT user_id, value / 25 AS k FROM events) WHERE k BETWEEN 0 AND 4 GROUP BY ALL")
def histogram_bins(spark, sf_dir):
    return analytics.histogram(table(spark, sf_dir, "events"), "user_id", F.col("value") / 25, [0, 1, 2, 3, 4])


@query("SELECT event_type, floor(value / 10)::BIGINT AS setting, count(*) AS runs, round(avg(value), 6) AS cost, round(avg((props->>'$.k')::BIGINT), 6) AS k FROM events GROUP BY ALL")
def report_rows(spark, sf_dir):
    rows = runs(spark, sf_dir).withColumn("k", json.get(json.parse(F.col("props")), "$.k", "long"))
    found = analytics.report(rows, "event_type", "setting", cost="value", k="k")
    return found.withColumns({"cost": F.round("cost", 6), "k": F.round("k", 6)})


@query("SELECT r_name AS config, unnest(range(10, 201 + 100 * r_regionkey, 10)) AS block_size FROM region")
def sweep_grid(spark, sf_dir):
    configs = table(spark, sf_dir, "region").select(F.col("r_name").alias("config"), "r_regionkey")
    return analytics.sweep(configs, 10, 200 + 100 * F.col("r_regionkey"), 10).select("config", "block_size")


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, json_exists(props, '$.k') AS has_k, coalesce((props->>'$.missing')::BIGINT, -1) AS missing, len(json_keys(props))::INT AS members FROM events")
def json_extract(spark, sf_dir):
    value = json.parse(F.col("props"))
    return table(spark, sf_dir, "events").select(
        "event_id", json.get(value, "$.k", "long").alias("k"), json.is_member(F.col("props"), "k").alias("has_k"), json.get(value, "$.missing", "long", -1).alias("missing"), json.size(F.col("props")).alias("members")
    )


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, event_id AS last, 2::BIGINT AS length, [0, 7] AS whole FROM events")
def json_make(spark, sf_dir):
    """Values put at paths that aren't there yet, and read again."""
    events = table(spark, sf_dir, "events")
    text = json.made(json.made(F.col("props"), "$.a.b[1]", F.col("event_id").cast("string")), "$.a.list", F.lit("[0, 7]"))
    value = json.parse(text)
    return events.select(
        "event_id", json.get(value, "$.k", "long").alias("k"), json.get(value, "$.a.b[1]", "long").alias("last"), F.json_array_length(F.get_json_object(text, "$.a.b")).cast("long").alias("length"),
        json.get(value, "$.a.list", "array<int>").alias("whole"),
    )


@query("SELECT event_id, CASE WHEN json_valid(cut) THEN NULL ELSE length(cut) END::INT AS at FROM (SELECT event_id, left(props, (3 + event_id % 20)::INT) AS cut FROM events)")
def json_problems(spark, sf_dir):
    """Where texts that were cut off stop being JSON: at their ends, if a name, a number or a bracket is missing."""
    cut = F.substring(F.col("props"), F.lit(1), (F.col("event_id") % 20 + 3).cast("int"))
    found = table(spark, sf_dir, "events").select("event_id", cut.alias("cut"), json.problem(cut).alias("p"))
    # an open text is reported where it begins
    at = F.when(F.col("p.message").startswith("Unterminated string"), F.length("cut")).otherwise(F.col("p.at"))
    return found.select("event_id", at.alias("at"))


@query("SELECT event_id, unnest(json_keys(props)) AS key, (props->>'$.k')::BIGINT AS value FROM events")
def json_iterate(spark, sf_dir):
    """The members of each object (they have one, k)."""
    rows = table(spark, sf_dir, "events").select("event_id", json.parse(F.col("props")).alias("v"))
    return json.entries(rows, "v", "event_id").select("event_id", "key", F.try_variant_get("value", "$", "long").alias("value"))


@query("SELECT event_id, sign((props->>'$.k')::BIGINT - 50)::INT AS with_number, -1 AS with_text, 1 AS with_null, CASE WHEN props->>'$.k' = '50' THEN 0 WHEN props < '{\"k\":50}' THEN -1 ELSE 1 END AS with_object FROM (SELECT event_id, replace(props, ' ', '') AS props FROM events)")
def json_compare(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", json.parse(F.col("props")).alias("v"))
    k, other = F.variant_get("v", "$.k", "variant"), lambda text: F.parse_json(F.lit(text))
    return rows.select(
        "event_id", json.compared(k, other("50")).alias("with_number"), json.compared(k, other('"50"')).alias("with_text"), json.compared(k, other("null")).alias("with_null"),
        json.compared(F.col("v"), other('{"k": 50}')).alias("with_object"),
    )


@query("SELECT event_type, count(*) AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY event_type")
def json_roundtrip(spark, sf_dir):
    """Written as JSON objects and read again."""
    rows = table(spark, sf_dir, "events").select(json.write(F.struct("event_type", json.get(json.parse(F.col("props")), "$.k", "long").alias("k"))).alias("value"))
    read = rows.select(F.from_json("value", "event_type string, k long").alias("r")).select("r.*")
    return read.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS day, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def windowed_sketch_keys(spark, sf_dir):
    """The distinct users of each day, from the days' tables of keys."""
    events = table(spark, sf_dir, "events")
    days = events.select(F.date_trunc("day", "ts").alias("day"), F.col("user_id").alias("key")).distinct()
    spec = iblt.Spec(1 << 14, 4)
    cells = iblt.build(days, spec, "day")
    per_day = cells.where("sub = 0").groupBy("day").agg(F.sum("cnt").alias("users"))
    return per_day.select(F.col("day").cast("timestamp_ntz").alias("day"), "users")


CLICKS_SQL, VIEWS_SQL = (f"SELECT date_trunc('day', ts)::TIMESTAMP AS start, user_id AS key FROM events WHERE event_type = '{t}' AND user_id IS NOT NULL" for t in ("click", "view"))


@query(
    f"""SELECT * FROM (SELECT *, 'A' AS side FROM (({CLICKS_SQL}) EXCEPT ({VIEWS_SQL})) UNION ALL SELECT *, 'B' AS side FROM (({VIEWS_SQL}) EXCEPT ({CLICKS_SQL})))
    WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events WHERE event_type IN ('click', 'view') AND user_id IS NOT NULL)"""
)
def streamed_differences(spark, sf_dir):
    """The users who clicked but didn't view or viewed but didn't click, for each day that the stream has passed by two hours."""
    source, side = table(spark, sf_dir, "events"), F.when(F.col("event_type") == "click", "A").when(F.col("event_type") == "view", "B")
    ts = F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"))  # whatever the session's zone is

    def events():
        stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, as a stream takes no single file
        return stream.select(ts.alias("ts"), F.col("user_id").alias("key"), side.alias("side"))

    # an estimate of the largest day's users; days that don't fit are streamed again
    users = source.where(side.isNotNull()).groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.approx_count_distinct("user_id").alias("n")).agg(F.max("n").alias("n")).first().n
    spec, folder = iblt.Spec(1 << 14, 4), f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    rows = reconcile_streams.all_differences(events, spec, "ts", "1 day", "2 hours", folder, reconcile_streams.segments_for(users or 0, spec)).where("key is not null")
    return rows.select(F.expr("timestampadd(MICROSECOND, start, TIMESTAMP_NTZ'1970-01-01 00:00:00')").alias("start"), "key", "side")


# Tables as multisets of rows

ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
#: One order has another customer, every hundredth one is there twice.
CHANGED_SQL = "SELECT * REPLACE (CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders) THEN o_custkey + 1 ELSE o_custkey END AS o_custkey) FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 100 = 3"


def row_keys_sql(source: str) -> str:
    text = " || ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ORDER_COLUMNS)
    return f"SELECT ('0x' || substr(md5({text}), 1, 15))::BIGINT AS key FROM ({source})"


def order_versions(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    orders = table(spark, sf_dir, "orders").select(*ORDER_COLUMNS)
    least = orders.agg(F.min("o_orderkey").alias("least"))
    edited = orders.join(F.broadcast(least)).withColumn("o_custkey", F.when(F.col("o_orderkey") == F.col("least"), F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))).drop("least")
    changed = edited.unionByName(orders.where("o_orderkey % 100 = 3"))
    rows = {"as it is": orders, "in another order": orders.repartition("o_custkey").sortWithinPartitions(F.desc("o_orderkey")), "changed": changed}
    return {name: x.select(multisets.row_key(*ORDER_COLUMNS).alias("key")) for name, x in rows.items()}


def digest_sql(name: str, source: str) -> str:
    return f"SELECT '{name}' AS name, count(*) AS n, sum(key::HUGEINT)::VARCHAR AS first, sum({portable_sql('key', 0)}::HUGEINT)::VARCHAR AS second FROM ({row_keys_sql(source)})"


@query(" UNION ALL ".join(digest_sql(name, x) for name, x in (("as it is", "FROM orders"), ("in another order", "FROM orders"), ("changed", CHANGED_SQL))))
def table_digests(spark, sf_dir):
    """The first two are equal, the third tells that rows differ."""
    out = None
    for name, rows in order_versions(spark, sf_dir).items():
        one = multisets.digest(rows).select(F.lit(name).alias("name"), "n", F.col("first").cast("string").alias("first"), F.col("second").cast("string").alias("second"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    f"""SELECT key, (sum(times))::BIGINT AS times FROM (SELECT key, 1 AS times FROM ({row_keys_sql(CHANGED_SQL)}) UNION ALL SELECT key, -1 FROM ({row_keys_sql("FROM orders")})) GROUP BY key HAVING sum(times) <> 0"""
)
def table_differences(spark, sf_dir):
    """Which rows the changed table has more or less often, without a join."""
    rows = order_versions(spark, sf_dir)
    return multisets.differences(rows["changed"], rows["as it is"])
