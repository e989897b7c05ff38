"""Making one directory like another with as few transfers as possible, and in an order that loses nothing.

Contents that the other side has somewhere are renamed to where they belong, each source to one target; more targets of a
content than sources are copies, contents it lacks are fetched, and what is left over is deleted.

Renames form chains (a to b, b to c: the last one goes first) and cycles (a to b, b to a). A path is the source of one
rename and the target of one at most. By pointer jumping every rename learns how far it is from its chain's end, in as many rounds as
the longest chain's length has bits; what never gets to an end is in a cycle, whose least path is found by the same jumps and steps
aside to a name of its own first. So the steps are counted without walking along the chains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symdiff.operators.sets import ranked
from symdiff.plans.tables import settled

#: What the path that steps aside is called meanwhile.
ASIDE = ".symdiff-aside"


def needs(mine: DataFrame, theirs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(wanted, free, kept): my entries that they don't have so, theirs that I don't have so, and the common ones, as (path, content)."""
    a, b = (x.select("path", F.col("content_sha1").alias("content")) for x in (mine, theirs))
    return a.join(b, ["path", "content"], "left_anti"), b.join(a, ["path", "content"], "left_anti"), a.join(b, ["path", "content"], "left_semi")


def matched(wanted: DataFrame, free: DataFrame) -> DataFrame:
    """(source, target, content): the i-th free path of a content goes to the i-th wanted one, in the order of paths."""
    sources, targets = (ranked(x, ["content"], ["path"], "place").withColumnRenamed("path", name) for x, name in ((free, "source"), (wanted, "target")))
    return sources.join(targets, ["content", "place"]).select("source", "target", "content")


def jumped(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((source, distance) of the edges (source, target) that lead to an end, (source, least) of those in cycles, with the
    cycle's least source). The last edge of a chain has distance 0."""
    onward = edges.select(F.col("source").alias("target"), F.lit(1).cast("long").alias("distance"))
    state = edges.join(onward, "target", "left").select("source", F.when(F.col("distance") == 1, F.col("target")).alias("next"), F.coalesce("distance", F.lit(0).cast("long")).alias("distance"), F.col("source").alias("least"))
    before = None
    while True:
        state = settled(state)
        left = state.where("next is not null").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("source", "least").cast("decimal(38,0)")).alias("least")).first()
        # The same number as before: only cycles are left. The same least paths: their windows go all around.
        if not left.n or (left.n, left.least) == before:
            return state.where("next is null").select("source", "distance"), state.where("next is not null").select("source", "least")
        before = (left.n, left.least)
        ahead = state.select(F.col("source").alias("next"), F.col("next").alias("after"), F.col("distance").alias("more"), F.col("least").alias("other"))
        jumps = state.where("next is not null").join(ahead, "next").select("source", F.col("after").alias("next"), (F.col("distance") + F.col("more")).alias("distance"), F.least("least", "other").alias("least"))
        state = state.where("next is null").unionByName(jumps)


def ordered(renames: DataFrame) -> DataFrame:
    """(step, action, source, target) of renames (source, target); steps of one number can be taken at once."""
    renames = settled(renames.select("source", "target"))
    chains, cycles = jumped(renames)
    cycles = settled(cycles)
    straight = renames.join(chains, "source").select(F.col("distance").alias("step"), "source", "target")
    # Cut behind the least path: who goes there can go second, as it has stepped aside.
    round_ = renames.join(cycles, "source")
    cut = settled(round_.withColumn("target", F.when(F.col("target") == F.col("least"), F.concat("target", F.lit(ASIDE))).otherwise(F.col("target"))))
    distances, _ = jumped(cut.select("source", "target"))
    turns = round_.join(distances, "source")
    aside = turns.where("source = least")
    first = aside.select(F.lit(0).cast("long").alias("step"), "source", F.concat("source", F.lit(ASIDE)).alias("target"))
    others = turns.where("source <> least").select((F.col("distance") + 1).alias("step"), "source", "target")
    last = aside.select((F.col("distance") + 1).alias("step"), F.concat("source", F.lit(ASIDE)).alias("source"), "target")
    steps = straight.unionByName(first).unionByName(others).unionByName(last)
    return steps.select("step", F.lit("rename").alias("action"), "source", "target")


def move_plan(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """(phase, step, action, source, target, content): what makes theirs like mine, of manifests (path, content_sha1), each path once.

    Phase 0 deletes paths that nobody wants (target null), phase 1 renames, step by step, phase 2 copies contents from where they are by then
    and fetches those that aren't there (source null). Whatever is at a target is overwritten.
    """
    wanted, free, kept = (settled(x) for x in needs(mine, theirs))
    renames = settled(matched(wanted, free))
    missing = wanted.join(renames.select(F.col("target").alias("path")), "path", "left_anti")
    there = kept.unionByName(renames.select(F.col("target").alias("path"), "content")).groupBy("content").agg(F.min("path").alias("source"))
    filled = missing.join(there, "content", "left")
    second = filled.select(F.lit(2).alias("phase"), F.lit(0).cast("long").alias("step"), F.when(F.col("source").isNull(), "fetch").otherwise("copy").alias("action"), "source", F.col("path").alias("target"), "content")
    gone = free.join(renames.select(F.col("source").alias("path")), "path", "left_anti").join(mine.select("path"), "path", "left_anti")
    zero = gone.select(F.lit(0).alias("phase"), F.lit(0).cast("long").alias("step"), F.lit("delete").alias("action"), F.col("path").alias("source"), F.lit(None).cast("string").alias("target"), "content")
    contents = renames.select("source", "content").unionByName(renames.select(F.concat("source", F.lit(ASIDE)).alias("source"), "content"))
    first = ordered(renames).join(contents, "source").select(F.lit(1).alias("phase"), "step", "action", "source", "target", "content")
    return zero.unionByName(first).unionByName(second)


def applied(theirs: DataFrame, plan: DataFrame) -> DataFrame:
    """(path, content_sha1): the directory after the plan. As each step's content is known, what is at a path is what came there last, or
    what was there and didn't go."""
    plan = plan.select("phase", "step", "action", "source", "target", "content")
    came = plan.where("target is not null").select(F.col("target").alias("path"), "phase", "step", F.lit(1).alias("here"), "content")
    went = plan.where("action in ('rename', 'delete')").select(F.col("source").alias("path"), "phase", "step", F.lit(0).alias("here"), F.lit(None).cast("string").alias("content"))
    was = theirs.select("path", F.lit(-1).alias("phase"), F.lit(0).cast("long").alias("step"), F.lit(1).alias("here"), F.col("content_sha1").alias("content"))
    last = was.unionByName(came).unionByName(went).groupBy("path").agg(F.max_by(F.struct("here", "content"), F.struct("phase", "step", "here")).alias("last"))
    return last.where("last.here = 1").select("path", F.col("last.content").alias("content_sha1"))
