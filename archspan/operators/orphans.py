"""References to records that do not exist (problem 1).

A Bloom filter of the parent keys is built by Spark (one 64-bit word per block,
``bit_or`` per block): a reference whose bits are not all set is a definite orphan.
Only filter-positive references are joined with the parents. The filter has a word
for every few keys, however many there are. It is broadcast up to a fixed size;
beyond it the words are joined with the references by block, so that every task
holds the words of its own blocks and the share of false positives stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from archspan.functions import names
from archspan.runtime import Scratch

#: A filter of at most this many words is broadcast: 8 MB of bits, as a hash relation of
#: (block, word) rows some 40 MB in each executor.
BROADCAST_WORDS = 1 << 20
KEYS_PER_WORD = 4
BITS_PER_KEY = 4


def _word_mask(hash_: Column) -> Column:
    """The bits of a key within its 64-bit word."""
    mask = F.lit(0).cast("bigint")
    for i in range(BITS_PER_KEY):
        bit = F.shiftrightunsigned(hash_, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit))
    return mask


def _block(keys: list[Column], blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), *keys), F.lit(blocks))


def bloom_filter(parents: DataFrame, keys: list[str], n_keys: int) -> tuple[DataFrame, int]:
    """(block, word) rows of a blocked Bloom filter over the parents' keys, and its number of blocks, one per KEYS_PER_WORD keys.

    Null keys are left out.
    """
    cols = [F.col(k) for k in keys]
    blocks = max(64, -(-n_keys // KEYS_PER_WORD))
    words = parents.dropna(subset=keys).select(_block(cols, blocks).alias("block"), _word_mask(F.xxhash64(F.lit("bits"), *cols)).alias("mask"))
    return words.groupBy("block").agg(F.bit_or("mask").alias("word")), blocks


def probe(refs: DataFrame, words: DataFrame, blocks: int, keys: list[str], broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """``refs`` with the flag ``maybe``: false proves that no parent has the key.

    A filter of more blocks than ``broadcast_words`` is joined by block instead of
    broadcast. References of one key all go to one block, so they are counted once per
    key and the flag is joined back; a hot key is split by the adaptive skew join.
    """
    cols = [F.col(k) for k in keys]
    sized = words.withColumnRenamed("block", "_block")
    hit = F.coalesce(F.col("word").bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False))
    asked = refs if blocks <= broadcast_words else refs.select(*keys).distinct()
    probed = asked.withColumn("_block", _block(cols, blocks)).withColumn("_mask", _word_mask(F.xxhash64(F.lit("bits"), *cols)))
    small = blocks <= broadcast_words
    flagged = probed.join(F.broadcast(sized) if small else sized, "_block", "left").withColumn("maybe", hit).drop("_block", "_mask", "word")
    return flagged if small else refs.join(flagged, keys)


def references(constraints: DataFrame) -> DataFrame:
    """One row per reference to judge: the key kind is ``P`` (name or anything below it) or ``E`` (exactly the name)."""
    label = F.coalesce(F.col("object_grounding.label"), F.lit(""))

    def plain(c: str) -> Column:
        return F.regexp_replace(F.trim(F.col(c)), names.WILDCARD, "")

    def item(field: str, kind: str, name: Column, judged: Column) -> Column:
        return F.when(judged, F.struct(F.lit(field).alias("field_name"), F.lit(kind).alias("kind"), name.alias("name")))

    return (
        constraints.withColumn(
            "_ref",
            F.explode(
                F.array_compact(
                    F.array(
                        item("subject", "P", plain("subject"), F.lit(True)),
                        item("object", "P", plain("object"), label != "unique_suffix"),
                        item("grounding", "E", F.col("object_grounding.resolved_fqn"), label.isin("exact", "unique_suffix")),
                    )
                )
            ),
        )
        .select("constraint_id", "repo_id", "recorded_at", "_ref.*")
        .where(F.col("recorded_at").isNotNull() & F.col("repo_id").isNotNull() & F.col("name").isNotNull())
    )


def parent_keys(nodes: DataFrame) -> DataFrame:
    """Node rows by every name that a reference may use: their ancestors (``P``) and themselves (``E``)."""
    own = F.struct(F.lit("E").alias("kind"), F.col("fqn").alias("name"))
    above = F.transform(names.ancestors("fqn"), lambda a: F.struct(F.lit("P").alias("kind"), a.alias("name")))
    return nodes.where(F.col("fqn").isNotNull()).select("repo_id", "loaded_at", "deleted_at", F.explode(F.concat(F.array(own), above)).alias("_k")).select("repo_id", "_k.*", "loaded_at", "deleted_at")


KEY = ["repo_id", "kind", "name"]


def orphan_references(constraints: DataFrame, nodes: DataFrame, scratch: Scratch | None = None, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """Every reference of ``constraints`` that names no living node: (constraint_id, field_name, ref_month, reason).

    reason is ``late`` if a row of that name was loaded after recorded_at, else
    ``deleted`` if there are rows, else ``missing``. Rows of other columns are
    ignored. A reference that is null, or has no repository or no time, refers to
    nothing and is not judged; an empty name matches no node and is ``missing``.
    Repeated rows give one row. Rows deleted at or before they were loaded never
    lived, but count for ``late`` and ``deleted``.

    Parents are aggregated per key before the shuffle and written once; the filter,
    its size and the exact join read that table. The time line of a hot key is cut
    into days (`_living_by_day`), so no task holds all rows of a key.
    """
    scratch = scratch or Scratch(nodes.sparkSession, "orphans")
    parents = parent_keys(nodes)
    per_key, n_keys = scratch.cut_counting(
        parents.groupBy(*KEY).agg(F.max("loaded_at").alias("last_load"), F.min(F.when(F.col("deleted_at").isNull(), F.col("loaded_at"))).alias("open_since")),
        F.lit(True),
    )
    words, blocks = bloom_filter(per_key, KEY, n_keys)
    probed = scratch.cut(probe(references(constraints).distinct(), words, blocks, KEY, broadcast_words))

    joined = probed.where("maybe").drop("maybe").join(per_key, KEY, "left")
    doubtful, n_asked = scratch.cut_counting(joined.where(F.col("open_since").isNull() | (F.col("open_since") > F.col("recorded_at"))).drop("open_since"), F.col("last_load").isNotNull())
    verified = doubtful
    if n_asked:
        alive = _alive_in_spans(doubtful.where(F.col("last_load").isNotNull()).select(*KEY, "recorded_at").distinct(), parents)
        verified = doubtful.join(alive, [*KEY, "recorded_at"], "left_anti")
    reason = F.when(F.col("last_load").isNull(), "missing").when(F.col("last_load") > F.col("recorded_at"), "late").otherwise("deleted")
    sure = probed.where(~F.col("maybe")).withColumn("reason", F.lit("missing"))
    out = verified.withColumn("reason", reason).drop("last_load").unionByName(sure.drop("maybe"))
    return out.select("constraint_id", "field_name", F.date_format("recorded_at", "yyyy-MM").alias("ref_month"), "reason").distinct()


def _alive_in_spans(asked: DataFrame, parents: DataFrame) -> DataFrame:
    """The (key, recorded_at) at which a row with an end lives: loaded at or before, deleted after."""
    span = parents.where(F.col("deleted_at") > F.col("loaded_at"))
    steps = (
        span.select(*KEY, F.explode(F.array(F.struct(F.col("loaded_at").alias("at"), F.lit(1).alias("step")), F.struct(F.col("deleted_at").alias("at"), F.lit(-1).alias("step")))).alias("_s"))
        .select(*KEY, "_s.*")
        .groupBy(*KEY, "at")
        .agg(F.sum("step").alias("step"))
        .join(asked.select(*KEY).distinct(), KEY, "left_semi")
    )
    return _living_by_day(asked, steps)


def _living_by_day(asked: DataFrame, steps: DataFrame) -> DataFrame:
    """Two-level running sum: whole days first, then within the day, so that a hot key spreads over its days."""
    day = F.to_date("at")
    points = steps.select(*KEY, "at", "step", F.lit(False).alias("ask")).unionByName(asked.select(*KEY, F.col("recorded_at").alias("at"), F.lit(0).cast("bigint").alias("step"), F.lit(True).alias("ask")))
    points = points.withColumn("day", day)
    days = points.groupBy(*KEY, "day").agg(F.sum("step").alias("day_step"))
    before = days.withColumn("before", F.sum("day_step").over(W.partitionBy(*KEY).orderBy("day").rowsBetween(W.unboundedPreceding, -1))).drop("day_step")
    within = F.sum("step").over(W.partitionBy(*KEY, "day").orderBy("at").rangeBetween(W.unboundedPreceding, W.currentRow))
    living = points.withColumn("within", within).where("ask").join(before, [*KEY, "day"]).where(F.coalesce(F.col("before"), F.lit(0)) + F.col("within") > 0)
    return living.select(*KEY, F.col("at").alias("recorded_at"))


def orphan_report(found: dict[str, DataFrame]) -> DataFrame:
    """Orphans of each table (by its name) counted per field, month and reason."""
    parts = [df.groupBy("field_name", "ref_month", "reason").agg(F.count(F.lit(1)).alias("n_orphans")).select(F.lit(table).alias("table_name"), "*") for table, df in found.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def edge_orphans(edges: DataFrame, nodes: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Ends of dependency edges that name no node of their repository living at loaded_at, as `orphan_references` has them.

    (ord, field_name, ref_month, reason) with field_name ``source`` or ``target``; an
    end holds if a node has this name or one below it.
    """
    named = edges.select(F.col("ord").alias("constraint_id"), "repo_id", F.col("source").alias("subject"), F.col("target").alias("object"), F.lit(None).cast("struct<label:string,resolved_fqn:string>").alias("object_grounding"), F.col("loaded_at").alias("recorded_at"))
    found = orphan_references(named, nodes, scratch)
    field = F.when(F.col("field_name") == "subject", "source").otherwise("target")
    return found.select(F.col("constraint_id").alias("ord"), field.alias("field_name"), "ref_month", "reason")
