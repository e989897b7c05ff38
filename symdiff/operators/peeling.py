"""Tables of n parties that are decoded by rounds over the cluster, with the keys' holders where they are asked for.

A row (groups..., sub, cell, chunk, total, v0..v31[, party0...]) stands for 32 bits of a cell's keys or, in the last
chunk, checksums: v0..v31 are the sums of the coefficients of the keys that have these bits, modulo the field's size, `total` is the sum
of all coefficients. Keys are numbers of up to 64 bits or byte strings of one fixed width. Rows add up, so building, adding and
peeling are unions under one aggregation, which Spark does partly before the shuffle: what is shuffled is bounded by
cells and tasks. No row or task holds more than a cell's chunk.

A cell whose sums are all 0 or c in every chunk, with a checksum that fits, holds one key c times. A round takes all such
cells, subtracts their keys and adds up again.

Holders: the cells also XOR a bit for each party that has a key. Keys that all n parties have cancel in the sums but leave their
bits, all of them: `total`, which isn't reduced then, tells whether their number is odd, and with it what to take away.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symdiff.functions.hashing import family, low_bits
from symdiff.functions.unsigned import wrapping
from symdiff.operators import iblt, strata, strings
from symdiff.plans.tables import settled

CHUNK_BITS = 32
#: Parties whose bits share a column.
LANE = 62
BITS = [f"v{i}" for i in range(CHUNK_BITS)]
LEAST_CELLS = 80


@dataclass(frozen=True)
class Shape:
    """modulus: the number of parties or a prime; key_bits: a multiple of 32; parties: their number if holders are kept."""

    spec: iblt.Spec
    modulus: int
    key_bits: int = 32
    is_string: bool = False
    parties: int = 0

    def __post_init__(self):
        if self.key_bits < 1 or self.key_bits % CHUNK_BITS or not self.is_string and self.key_bits > 64:
            raise ValueError("keys are numbers of 32 or 64 bits, or byte strings of a multiple of 4 bytes")
        if self.parties and self.parties != self.modulus:
            raise ValueError("holders can be told modulo the number of parties only")
        if self.is_string and self.spec.hash != "portable":
            raise ValueError("byte strings are placed by the portable hash")

    @property
    def chunks(self) -> int:
        return self.key_bits // CHUNK_BITS + 1

    @property
    def lanes(self) -> list[str]:
        return [f"party{j}" for j in range(-(-self.parties // LANE))]

    @property
    def place(self) -> list[str]:
        return ["sub", "cell", "chunk"]

    def number(self, key: Column) -> Column:
        return strings.number_of(key) if self.is_string else key

    def check(self, key: Column) -> Column:
        return low_bits(family(self.spec.hash)(self.number(key), 0), CHUNK_BITS)

    def parts(self, key: Column) -> list[Column]:
        """The key, 32 bits at a time."""
        n = self.key_bits // CHUNK_BITS
        if self.is_string:
            return [F.conv(F.hex(F.substring(key, 4 * j + 1, 4)), 16, 10).cast("long") for j in range(n)]
        return [low_bits(F.shiftrightunsigned(key, CHUNK_BITS * j), CHUNK_BITS) for j in range(n)]

    def joined(self, parts: list[Column]) -> Column:
        if self.is_string:
            return F.unhex(F.concat(*(F.lpad(F.hex(p), 8, "0") for p in parts)))
        return reduce(lambda a, b: a.bitwiseOR(b), (F.shiftleft(p, CHUNK_BITS * j) for j, p in enumerate(parts)))


def power(i: Column | int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i if isinstance(i, Column) else F.lit(i))


def everyone(shape: Shape) -> list[int]:
    """Each lane's bits of all parties."""
    return [(1 << min(LANE, shape.parties - LANE * j)) - 1 for j in range(len(shape.lanes))]


def summed(rows: DataFrame, shape: Shape, *groups: str) -> DataFrame:
    total = F.sum("total")
    sums = [F.pmod(F.sum(v), F.lit(shape.modulus)).alias(v) for v in BITS]
    out = rows.groupBy(*groups, *shape.place).agg((total if shape.parties else F.pmod(total, F.lit(shape.modulus))).alias("total"), *sums, *(F.bit_xor(c).alias(c) for c in shape.lanes))
    return out.where((F.col("total") != 0) | (F.greatest(*BITS) != 0))


def rows_of(keys: DataFrame, shape: Shape, *groups: str) -> DataFrame:
    """The rows of (groups..., key, coefficient, lanes...), not yet added up."""
    with wrapping(keys.sparkSession):
        chunks = F.array(*shape.parts(F.col("key")), shape.check(F.col("key")))
        placed = keys.select(*groups, F.col("coefficient").cast("long").alias("total"), *shape.lanes, chunks.alias("chunks"), F.explode(iblt.cells_of(shape.number(F.col("key")), shape.spec)).alias("at"))
        each = placed.select(*groups, "at.sub", "at.cell", "total", *shape.lanes, F.posexplode("chunks").alias("chunk", "bits"))
        return each.select(*groups, *shape.place, "total", *(F.when(F.getbit("bits", F.lit(i)) == 1, F.col("total")).otherwise(F.lit(0).cast("long")).alias(v) for i, v in enumerate(BITS)), *shape.lanes)


def build(memberships: DataFrame, shape: Shape, *groups: str) -> DataFrame:
    """The sum of the tables of distinct memberships (groups..., key[, coefficient][, party])."""
    keys = memberships if "coefficient" in memberships.columns else memberships.withColumn("coefficient", F.lit(1))
    bit = lambda j: F.when((F.col("party") >= LANE * j) & (F.col("party") < LANE * (j + 1)), power((F.col("party") - LANE * j).cast("int"))).otherwise(F.lit(0).cast("long"))
    return summed(rows_of(keys.withColumns({c: bit(j) for j, c in enumerate(shape.lanes)}), shape, *groups), shape, *groups)


def add(a: DataFrame, b: DataFrame, shape: Shape, *groups: str) -> DataFrame:
    return summed(a.unionByName(b), shape, *groups)


def pure(table: DataFrame, shape: Shape, *groups: str) -> DataFrame:
    """(groups..., sub, cell, key, coefficient, lanes...) of the cells that hold one key."""
    with wrapping(table.sparkSession):
        c = F.pmod("total", F.lit(shape.modulus))
        fits = reduce(and_, ((F.col(v) == 0) | (F.col(v) == F.col("c")) for v in BITS), F.col("c") > 0)
        value = reduce(lambda a, b: a + b, (F.when(F.col(v) != 0, power(i)).otherwise(F.lit(0).cast("long")) for i, v in enumerate(BITS)))
        each = table.withColumn("c", c).where(fits).select(*groups, *shape.place, "c", "total", value.alias("value"), *shape.lanes)
        part = lambda j: F.max(F.when(F.col("chunk") == j, F.col("value"))).alias(f"part{j}")
        whole = each.groupBy(*groups, "sub", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("c").alias("coefficient"), F.max("total").alias("total"), *map(part, range(shape.chunks)), *(F.max(x).alias(x) for x in shape.lanes))
        cells = whole.where(F.col("n") == shape.chunks).withColumn("key", shape.joined([F.col(f"part{j}") for j in range(shape.chunks - 1)]))
        at = F.element_at(iblt.cells_of(shape.number(F.col("key")), shape.spec), F.col("sub") + 1)["cell"]
        cells = cells.where((shape.check(F.col("key")) == F.col(f"part{shape.chunks - 1}")) & (at == F.col("cell")))
        if shape.parties:
            odd = F.pmod((F.col("total") - F.col("coefficient")) / shape.modulus, F.lit(2)) == 1
            cells = cells.withColumns({x: F.when(odd, F.col(x).bitwiseXOR(F.lit(all_))).otherwise(F.col(x)) for x, all_ in zip(shape.lanes, everyone(shape), strict=True)})
            cells = cells.where(reduce(lambda a, b: a + b, (F.bit_count(x) for x in shape.lanes)) == F.col("coefficient"))
        return cells.select(*groups, "sub", "cell", "key", "coefficient", *shape.lanes)


def left_over(table: DataFrame, shape: Shape) -> DataFrame:
    """The rows of cells that aren't empty."""
    return table.where((F.pmod("total", F.lit(shape.modulus)) != 0) | (F.greatest(*BITS) != 0))


def peel_rounds(table: DataFrame, shape: Shape, *groups: str) -> tuple[DataFrame, DataFrame]:
    """((groups..., key, coefficient[, parties]), what is left of tables that couldn't be decoded): every round is one aggregation over the cells
    for pure ones, and one for what remains. A round without new keys ends it, which a false checksum can't put off."""
    table, parts = settled(table), []
    while True:
        new = pure(table, shape, *groups).groupBy(*groups, "key").agg(F.max("coefficient").alias("coefficient"), *(F.max(x).alias(x) for x in shape.lanes))
        for before in parts:
            new = new.join(before, [*groups, "key"], "left_anti")
        new = settled(new)
        if new.isEmpty():
            break
        parts.append(new)
        taken = rows_of(new.withColumn("coefficient", -F.col("coefficient")), shape, *groups)
        table = settled(summed(table.unionByName(taken), shape, *groups))
    found = reduce(DataFrame.unionByName, parts, new)
    if shape.parties:
        bits = [F.getbit(x, F.lit(i)) for j, x in enumerate(shape.lanes) for i in range(min(LANE, shape.parties - LANE * j))]
        held = F.filter(F.array(*(F.when(b == 1, F.lit(p).cast("long")) for p, b in enumerate(bits))), lambda p: p.isNotNull())
        found = found.select(*groups, "key", "coefficient", held.alias("parties"))
    return found, left_over(table, shape)


def partial_estimate(memberships: DataFrame) -> int:
    """Of the number of keys that some but not all parties have, from strata of each party against the first: a key
    differs from the first party's somewhere if it isn't in all of them or none. Usually too large, as it counts by party."""
    first = memberships.agg(F.min("party").alias("p"), F.max("party").alias("q")).first()
    if first.p is None or first.p == first.q:
        return 0
    others = F.sequence(F.lit(first.p + 1), F.lit(first.q))
    mine = memberships.where(F.col("party") == first.p).select("key", F.lit(1).alias("sign"), F.explode(others).alias("pair"))
    signed = mine.unionByName(memberships.where(F.col("party") > first.p).select("key", F.lit(-1).alias("sign"), F.col("party").alias("pair")))
    placed = strata.assigned_bytes(signed) if dict(signed.dtypes)["key"] == "binary" else strata.assigned(signed)
    cells = iblt.build(placed.withColumn("stratum", F.col("pair") * strata.STRATA + F.col("stratum")), strata.STRATUM, "stratum")
    peeled = iblt.peel_each(cells, strata.STRATUM, "stratum").groupBy("stratum").agg(F.min("ok").alias("ok"), F.count("key").alias("n"))
    pair, level = F.floor(F.col("stratum") / strata.STRATA), F.col("stratum") % strata.STRATA
    by_pair = peeled.groupBy(pair.alias("pair")).agg(F.collect_list(F.struct(level.alias("level"), "ok", "n")).alias("strata"))
    # The highest stratum that fails scales what was decoded above it.
    failed = F.array_max(F.transform(F.filter("strata", lambda s: ~s["ok"]), lambda s: s["level"]))
    above = F.aggregate(F.filter("strata", lambda s: s["level"] > F.coalesce("failed", F.lit(-1))), F.lit(0).cast("long"), lambda a, s: a + s["n"])
    sized = by_pair.withColumn("failed", failed).select((above * F.when(F.col("failed").isNull(), F.lit(1).cast("double")).otherwise(F.pow(F.lit(2.0), F.col("failed") + 1))).alias("n"))
    return int(sized.agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("n")).first().n)


def reconcile(memberships: DataFrame, parties: int, key_bits: int = 32, holders: bool = False) -> DataFrame:
    """(key, coefficient[, parties]) of the keys that some but not all parties have, through tables sized by an estimate;
    a table that fails is made again with twice the cells. memberships: (party from 0, key), numbers or byte strings."""
    members = settled(memberships.select("party", "key").where("party is not null and key is not null").distinct())
    is_string = dict(members.dtypes)["key"] == "binary"
    cells = max(2 * partial_estimate(members), LEAST_CELLS)
    while True:
        shape = Shape(iblt.Spec(cells, 4, "portable" if is_string else "murmur"), parties, key_bits, is_string, parties if holders else 0)
        found, left = peel_rounds(build(members, shape), shape)
        if left.isEmpty():
            return found
        cells *= 2
