"""What changed between full snapshots (problem 7).

Snapshots of a line are put into chain order by pointer doubling over their sha
links; each key is then windowed by snapshot index: a lagged hash shows a change,
a gap in the indexes a removal and, where the key returns, an addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from archspan.runtime import Scratch

#: A snapshot index of at most this many rows (some 100 bytes each in memory) is broadcast; a longer one is joined.
BROADCAST_SNAPSHOTS = 500_000


def chain_index(snaps: DataFrame, scratch: Scratch) -> DataFrame:
    """(line_id, to_sha, seg, idx): position of each snapshot in its chain; ``seg`` is the first sha of the chain.

    ``snaps`` holds (line_id, from_sha, to_sha). A snapshot without predecessor in
    the line starts a chain. Each round doubles the distance that a pointer spans,
    so a chain of n snapshots takes log2(n) rounds. Snapshots on a ring of shas have
    no order and are left out. The rounds run when this is called.
    """
    open_ = F.col("ptr").isNotNull()
    known = snaps.dropna(subset=["line_id", "to_sha"]).groupBy("line_id", "to_sha").agg(F.min("from_sha").alias("from_sha"))
    there = known.select("line_id", F.col("to_sha").alias("from_sha"), F.col("to_sha").alias("ptr"))
    links = known.join(there, ["line_id", "from_sha"], "left")
    state, left = scratch.cut_counting(links.select("line_id", "to_sha", "ptr", F.coalesce("ptr", "to_sha").alias("seg"), F.when(open_, 1).otherwise(0).alias("idx")), open_)
    while left:
        far = state.select("line_id", F.col("to_sha").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("seg").alias("seg2"), F.col("idx").alias("idx2"))
        moved = state.where(open_).join(far, ["line_id", "ptr"]).select("line_id", "to_sha", F.col("ptr2").alias("ptr"), F.col("seg2").alias("seg"), (F.col("idx") + F.col("idx2")).alias("idx"))
        new, now = scratch.cut_counting(state.where(~open_).unionByName(moved), open_)
        scratch.drop(state)
        state = new
        if now == left:
            break
        left = now
    return state.where(~open_).drop("ptr")


def changes(snapshots: DataFrame, scratch: Scratch, broadcast_snapshots: int = BROADCAST_SNAPSHOTS) -> DataFrame:
    """(line_id, to_sha, fqn, change_kind) against the snapshot of the same line whose to_sha is from_sha.

    Of rows repeated for a line, sha and fqn the one with the highest row_no holds.
    Hashes compare without case, null as '' (by two 64-bit digests, so that they travel as 16
    bytes). First snapshots, and ones whose predecessor was never delivered, give no
    rows. Rows without line_id, to_sha or fqn are ignored. If one sha is delivered with
    several from_shas, the least counts. Two successors of one snapshot are two
    chains that share their head; the later branches are then compared through the
    link itself (`_branched`).
    """
    rows = snapshots.dropna(subset=["line_id", "to_sha", "fqn"])
    text = F.lower(F.coalesce("code_hash", F.lit("")))
    hashed = rows.select("line_id", "to_sha", "fqn", F.struct("row_no", F.xxhash64(text).alias("a"), F.xxhash64(F.lit("again"), text).alias("b")).alias("last"))
    found = chain_index(rows.select("line_id", "from_sha", "to_sha"), scratch)
    chain = W.partitionBy("line_id", "seg")
    placed = found.withColumn("end_idx", F.max("idx").over(chain)).withColumn("twins", F.count(F.lit(1)).over(W.partitionBy("line_id", "seg", "idx")))
    index, (n, n_forked) = scratch.cut_counts(placed.withColumn("forked", F.max("twins").over(chain) > 1).drop("twins"), F.lit(True), F.col("forked"))
    side = lambda df: F.broadcast(df) if n <= broadcast_snapshots else df
    straight = _windowed(hashed, index.where("NOT forked").drop("forked"), side)
    return straight.unionByName(_branched(hashed, index.where("forked"), rows)) if n_forked else straight


def _windowed(hashed: DataFrame, index: DataFrame, side) -> DataFrame:
    """Window per key over the snapshot indexes of its chain.

    Rows are dealt out by key once: the row that holds and the window both follow from that.
    """
    keyed = hashed.join(side(index), ["line_id", "to_sha"]).select("line_id", "seg", "fqn", "idx", "end_idx", "last").repartition("line_id", "seg", "fqn")
    last = keyed.groupBy("line_id", "seg", "fqn", "idx", "end_idx").agg(F.max("last").alias("last"))
    key = W.partitionBy("line_id", "seg", "fqn").orderBy("idx")
    hash_ = F.struct("last.a", "last.b")
    seen = last.select("line_id", "seg", "fqn", "idx", "end_idx", hash_.alias("hash"))
    seen = seen.withColumn("prev_idx", F.lag("idx").over(key)).withColumn("prev_hash", F.lag("hash").over(key)).withColumn("next_idx", F.lead("idx").over(key))
    came = F.when(F.col("prev_idx").isNull() & (F.col("idx") > 0), F.lit("added")).when(F.col("prev_idx") < F.col("idx") - 1, F.lit("added")).when((F.col("prev_idx") == F.col("idx") - 1) & (F.col("prev_hash") != F.col("hash")), F.lit("changed"))
    gone = F.when((F.col("idx") < F.col("end_idx")) & (F.coalesce("next_idx", F.col("end_idx") + 1) > F.col("idx") + 1), F.lit("removed"))
    events = seen.select("line_id", "seg", "fqn", F.explode(F.array(F.struct(F.col("idx").alias("at"), came.alias("change_kind")), F.struct((F.col("idx") + 1).alias("at"), gone.alias("change_kind")))).alias("_e"))
    events = events.select("line_id", "seg", "fqn", "_e.*").where(F.col("change_kind").isNotNull())
    names = index.select("line_id", "seg", F.col("idx").alias("at"), "to_sha")
    return events.join(side(names), ["line_id", "seg", "at"]).select("line_id", "to_sha", "fqn", "change_kind")


def _branched(hashed: DataFrame, index: DataFrame, rows: DataFrame) -> DataFrame:
    """The same comparison for chains that fork: each snapshot's keys against those of its from_sha."""
    last = hashed.join(index.select("line_id", "to_sha"), ["line_id", "to_sha"], "left_semi").groupBy("line_id", "to_sha", "fqn").agg(F.max("last").alias("_l")).select("line_id", "to_sha", "fqn", F.struct("_l.a", "_l.b").alias("hash"))
    links = rows.join(index.where("idx > 0").select("line_id", "to_sha"), ["line_id", "to_sha"], "left_semi").groupBy("line_id", "to_sha").agg(F.min("from_sha").alias("from_sha"))
    now = last.join(links.select("line_id", "to_sha"), ["line_id", "to_sha"]).withColumnRenamed("hash", "now_hash")
    before = last.withColumnRenamed("to_sha", "from_sha").join(links, ["line_id", "from_sha"]).select("line_id", "to_sha", "fqn", F.col("hash").alias("old_hash"))
    both = now.join(before, ["line_id", "to_sha", "fqn"], "full")
    kind = F.when(F.col("old_hash").isNull(), "added").when(F.col("now_hash").isNull(), "removed").when(F.col("now_hash") != F.col("old_hash"), "changed")
    return both.withColumn("change_kind", kind).where(F.col("change_kind").isNotNull()).select("line_id", "to_sha", "fqn", "change_kind")
