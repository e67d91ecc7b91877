"""Sessions of late events and all their versions, by lifetimes of cuts.

Events (user, t, batch, h) arrive in batches, some late. At batch B a user's events of batches up to B form sessions:
neighbours at most GAP apart share one. No batch is replayed. Instead:

- A moment t is a start at B if the user has an event there and none in [t - GAP, t). Both are known from batches
  alone: it is born with the moment's first batch and dies with the least batch in the preceding gap, which a window
  over that range of time gives. Ends, symmetrically, look at the gap that follows.
- Each event's batch is matched as of its moment to the last start and the next end that live at that batch: the
  version of the session that this batch brings about. Events of one batch that meet the same start are one version.
- The versions of a living start retract each other in order of batch; the last of them is retracted by the version
  that the event which killed the start belongs to.
- Intervals of versions are nested or apart, so sorted by end, from inner to outer, all that a version holds lies
  right before it: its events are the difference of two running sums of new events.

Time is dealt out in parts of PARTS gaps, so that no task has all of a user: moments near a border are copied into the
next part for the range windows, and what an event doesn't find in its own part is asked of the next ones, in rounds
that end with the longest session. Running sums go by ranges of the sorted versions. The versions of one start are one
group of a window (a session that goes on through n batches has n).

Defined results: rows with a null user, t or batch are no events; a null h counts as 0; equal events count each; an empty
table has no version; order of rows doesn't matter; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardline.operators.ordered import running
from wardline.sources.scratch import Store

GAP = 240
#: Gaps in a part of time.
PARTS = 16


def _floor(x: str, n: int) -> Column:
    """floor(x / n) of whole numbers, exact for large and negative ones."""
    return F.expr(f"({x} - pmod({x}, {n})) div {n}")


def events_of(conversations: DataFrame) -> DataFrame:
    """(user, t, batch, h) of conversation turns, as the registered query defines them."""
    crc = lambda x: F.crc32(x.cast("string").cast("binary"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("id"), F.col("turn").cast("long").alias("turn")).filter("turn IS NOT NULL AND id IS NOT NULL")
    rows = rows.withColumn("c", crc(F.col("id"))).withColumn("h", crc(F.concat_ws(":", "id", "turn")))
    rows = rows.withColumn("g", F.expr("h div 600")).withColumn("t", F.expr("(c div 2) % 7200 + 300 * turn + h % 600"))
    user = 2 * _floor("id", 8) + F.col("c") % 2
    batch = _floor("t", 1800) + F.when(F.col("g") % 5 == 0, F.col("g") % 4).otherwise(0)
    return rows.select(user.alias("user"), "t", batch.alias("batch"), "h")


def cuts(moments: DataFrame, gap: int, width: int) -> DataFrame:
    """(user, part, t, birth) -> also start_death, killer (the moment that kills the start), end_death; null: never."""
    near = lambda shift, cond: moments.filter(cond).select("user", (F.col("part") + shift).alias("part"), "t", "birth", F.lit(False).alias("own"))
    into = F.col("t") - F.col("part") * width
    whole = moments.select("user", "part", "t", "birth", F.lit(True).alias("own")).unionAll(near(1, into >= width - gap)).unionAll(near(-1, into < gap))
    by = W.partitionBy("user", "part").orderBy("t")
    first = F.min(F.struct("birth", "t"))
    seen = whole.withColumn("before", first.over(by.rangeBetween(-gap, -1))).withColumn("after", first.over(by.rangeBetween(1, gap)))
    return seen.filter("own").select("user", "part", "t", "birth", F.col("before.birth").alias("start_death"), F.col("before.t").alias("killer"), F.col("after.birth").alias("end_death"))


def _lives(death: str) -> Column:
    """Whether a cut lives at `batch`."""
    return (F.col("birth") <= F.col("batch")) & (F.col(death).isNull() | (F.col("batch") < F.col(death)))


def _asked(need: DataFrame, cut: DataFrame, side: int, name: str, store: Store) -> DataFrame:
    """(user, part, batch) -> with `name`, the nearest living cut of an earlier (side -1) or later (1) part, asked one after the other."""
    death = "start_death" if side < 0 else "end_death"
    best = F.max("t") if side < 0 else F.min("t")
    found, left = None, store.cut(need.withColumn("at", F.col("part") + side), "asked")
    while not left.isEmpty():
        there = cut.select("user", F.col("part").alias("at"), "t", "birth", death)
        got = left.join(there, ["user", "at"]).filter(_lives(death)).groupBy("user", "part", "batch").agg(best.alias(name))
        got = store.cut(got, "found")
        found = got if found is None else found.unionAll(got)
        after = store.cut(left.join(got, ["user", "part", "batch"], "left_anti").withColumn("at", F.col("at") + side), "asked")
        store.drop(left)
        left = after
    return found if found is not None else need.withColumn(name, F.lit(None).cast("long")).limit(0)


def matched(points: DataFrame, cut: DataFrame, store: Store) -> DataFrame:
    """points (user, part, t, batch, ...) with start and end: the session at each one's batch that it lies in."""
    batches = points.select("user", "part", "batch").distinct()
    living = lambda death: cut.filter(F.col(death).isNull() | (F.col(death) > F.col("birth"))).join(batches, ["user", "part"]).filter(_lives(death))
    none = F.lit(None).cast("long")
    starts = living("start_death").select("user", "part", "batch", "t", F.lit(0).alias("kind"), none.alias("n"), none.alias("h"), F.col("t").alias("s"), none.alias("e"))
    ends = living("end_death").select("user", "part", "batch", "t", F.lit(2).alias("kind"), none.alias("n"), none.alias("h"), none.alias("s"), F.col("t").alias("e"))
    asked = points.select("user", "part", "batch", "t", F.lit(1).alias("kind"), "n", "h", none.alias("s"), none.alias("e"))
    # At one moment the start comes before the event, and the event before the end.
    by = W.partitionBy("user", "part", "batch").orderBy("t", "kind")
    seen = starts.unionAll(asked).unionAll(ends)
    seen = seen.withColumn("start", F.last("s", True).over(by.rowsBetween(W.unboundedPreceding, 0)))
    seen = seen.withColumn("end", F.first("e", True).over(by.rowsBetween(0, W.unboundedFollowing)))
    seen = store.cut(seen.filter("kind = 1").drop("kind", "s", "e"), "matched")
    for name, side in (("start", -1), ("end", 1)):
        need = seen.filter(F.col(name).isNull()).select("user", "part", "batch").distinct()
        far = _asked(need, cut, side, "far", store)
        seen = seen.join(far, ["user", "part", "batch"], "left").withColumn(name, F.coalesce(name, "far")).drop("far")
    return store.cut(seen, "matched")


def held(found: DataFrame, store: Store) -> DataFrame:
    """Versions (user, batch, start, end, n_new, h_new) with n_events and h_sum, by running sums in order of ends."""
    none = F.lit(0).cast("decimal(38,0)")
    nodes = found.select("user", F.col("end").alias("at"), F.lit(1).alias("kind"), "start", "batch", F.col("n_new").cast("decimal(38,0)").alias("n"), F.col("h_new").cast("decimal(38,0)").alias("h"))
    # What ends before a version's start comes before its probe, all that it holds between probe and node.
    probes = found.select("user", F.col("start").alias("at"), F.lit(0).alias("kind"), "start", "batch", none.alias("n"), none.alias("h"))
    order = [F.col("user"), F.col("at"), F.col("kind"), F.col("start").desc(), F.col("batch")]
    sums = running(nodes.unionAll(probes), order, {"n_upto": F.col("n"), "h_upto": F.col("h")}, store)
    span = lambda x: (F.max(F.when(F.col("kind") == 1, F.col(x))) - F.max(F.when(F.col("kind") == 0, F.col(x)))).cast("long")
    return found.join(sums.groupBy("user", "start", "batch").agg(span("n_upto").alias("n_events"), span("h_upto").alias("h_sum")), ["user", "start", "batch"])


def versions(events: DataFrame, gap: int = GAP) -> DataFrame:
    """user, batch, start_s, end_s, n_events, n_new, n_retracted, h_sum, retracted_batch, retracted_start_s: a row for each version of a session."""
    store, width = Store(events.sparkSession), gap * PARTS
    points = events.filter("user IS NOT NULL AND t IS NOT NULL AND batch IS NOT NULL").groupBy("user", "t", "batch").agg(F.count("*").alias("n"), F.sum(F.coalesce("h", F.lit(0))).alias("h"))
    points = store.cut(points.withColumn("part", _floor("t", width)), "points")
    moments = points.groupBy("user", "part", "t").agg(F.min("batch").alias("birth"))
    cut = store.cut(cuts(moments, gap, width), "cuts")
    seen = matched(points, cut, store)
    found = store.cut(seen.groupBy("user", "batch", "start").agg(F.max("end").alias("end"), F.sum("n").alias("n_new"), F.sum("h").alias("h_new")), "versions")
    found = store.cut(held(found, store), "held")
    # The next version of the same start, or that of the event which killed it.
    after = F.lead("batch").over(W.partitionBy("user", "start").orderBy("batch"))
    killed = cut.filter("start_death > birth").select("user", F.col("t").alias("start"), "start_death", "killer")
    killers = seen.select("user", F.col("t").alias("killer"), F.col("batch").alias("start_death"), F.col("start").alias("into"))
    out = found.withColumn("next", after).join(killed, ["user", "start"], "left").join(killers, ["user", "killer", "start_death"], "left")
    out = out.withColumn("retracted_batch", F.coalesce("next", "start_death")).withColumn("retracted_start_s", F.when(F.col("next").isNotNull(), F.col("start")).otherwise(F.col("into")))
    out = store.cut(out, "retracted")
    retracts = out.filter("retracted_batch IS NOT NULL").groupBy("user", F.col("retracted_batch").alias("batch"), F.col("retracted_start_s").alias("start")).agg(F.count("*").alias("n_retracted"))
    out = out.join(retracts, ["user", "batch", "start"], "left")
    named = {"start_s": "start", "end_s": "end"}
    columns = ("user", "batch", "start_s", "end_s", "n_events", "n_new", "n_retracted", "h_sum", "retracted_batch", "retracted_start_s")
    out = store.cut(out.fillna(0, ["n_retracted"]).select(*[F.col(named.get(c, c)).cast("long").alias(c) for c in columns]), "sessions")
    store.close(out)
    return out
