import numpy as np
import pytest
from pyspark.sql import functions as F

from symdiff.functions import hashing, unsigned

# key: murmur64a of 8 bytes, of 4 bytes, of 8 bytes with the first seed
GOLDEN = {
    0: (8217090173679840641, 6960269033020761575, 10755453732387965745),
    1: (10357027354812746030, 17666132492028397833, 17946955010438205852),
    42: (15194948626179207696, 5448172522176930526, 1405145397833624654),
    123456789: (16794332799077805383, 15767399433641689928, 5107119034098600071),
}


def rows_of(*texts: bytes) -> np.ndarray:
    return np.frombuffer(b"".join(texts), dtype=np.uint8).reshape(len(texts), -1)


def test_murmur_columns_match_golden_vectors(spark):
    df = spark.createDataFrame([(k,) for k in GOLDEN], "key long")
    with unsigned.wrapping(spark):
        out = df.select(
            "key", *(unsigned.as_decimal(h) for h in (hashing.murmur64a(F.col("key")), hashing.murmur64a(F.col("key"), key_bytes=4), hashing.murmur64a(F.col("key"), hashing.SEEDS[0])))
        )
    assert {r[0]: tuple(map(int, r[1:])) for r in out.collect()} == GOLDEN
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_murmur_numpy_matches():
    keys = np.array(list(GOLDEN), dtype=np.uint64)
    assert hashing.murmur64a_numpy(keys).tolist() == [v[0] for v in GOLDEN.values()]
    assert hashing.murmur64a_bytes(rows_of(b"hello")).tolist() == [2191231550387646743]
    assert hashing.murmur64a_bytes(rows_of(bytes(range(17)))).tolist() == [11529254038519430509]


def test_lookup3_published_vectors():
    text = b"Four score and seven years ago"
    assert [hex(int(h[0])) for h in hashing.lookup3(rows_of(text))] == ["0x17770551", "0xce7226e6"]
    assert [hex(int(h[0])) for h in hashing.lookup3(rows_of(text), 1)] == ["0xcd628161", "0x6cbea4b3"]
    assert int(hashing.lookup3(np.zeros((1, 0), dtype=np.uint8))[0][0]) == 0xDEADBEEF


def test_mersenne_twister_published_value():
    assert int(hashing.mersenne_tables(5489, 4).ravel()[9999]) == 9981545732273789042


def test_murmur32_column(spark):
    def plain(key: int) -> int:
        m, mask = hashing.M32, 0xFFFFFFFF
        h = 8
        for word in (key & mask, key >> 32 & mask):
            k = word * m & mask
            h = (h * m & mask) ^ ((k ^ k >> 24) * m & mask)
        h = (h ^ h >> 13) * m & mask
        return h ^ h >> 15

    keys = [0, 1, 5, 123456789012345, (1 << 62) + 7]
    got = spark.createDataFrame([(k,) for k in keys], "key long").select("key", hashing.murmur32(F.col("key"))).collect()
    assert {r[0]: r[1] for r in got} == {k: plain(k) for k in keys}


def test_string_hashes_keep_nulls_and_lengths(spark):
    df = spark.createDataFrame([(b"",), (b"a",), (b"abcdefghijklmnop",), (None,)], "d binary")
    rows = df.select(hashing.bob_hash("d"), hashing.superfast_hash("d"), hashing.murmur64a_binary("d"), hashing.null_hash(F.col("d"))).collect()
    assert rows[0][1] == 0 and rows[1][3] == 0 and all(x is None for x in rows[3])
    assert rows[2][3] == sum(b << 8 * (3 - k) for k, b in enumerate(b"mnop"))


@pytest.mark.parametrize(("k", "expected"), [(0, 32), (1, 0), (2, 1), (3, 0), (32, 5), (-(1 << 63), 63)])
def test_trailing_zeroes(spark, k, expected):
    assert spark.range(1).select(hashing.trailing_zeroes(F.lit(k).cast("long"), 32)).first()[0] == expected


def test_unsigned_helpers(spark):
    values = [0, 1, (1 << 63) - 1, 1 << 63, (1 << 64) - 1]
    df = spark.createDataFrame([(unsigned.signed(v),) for v in values], "h long")
    assert [int(r[0]) for r in df.orderBy(unsigned.order_key(F.col("h"))).select(unsigned.as_decimal(F.col("h"))).collect()] == values
    assert [r[0] for r in df.select(unsigned.modulo(F.col("h"), 1000)).collect()] == [v % 1000 for v in values]


def test_tabulation_is_xor_of_chunks():
    t = hashing.mersenne_tables(0, 4)
    key = 0x0001000200030004
    assert int(hashing.tabulation(np.array([key], dtype=np.uint64))[0]) == int(t[0][4] ^ t[1][3] ^ t[2][2] ^ t[3][1])
