"""Mixing sources to target weights (problem 9).

Every text of a source gets the same number of certain whole copies; the rest of the
source's tokens is a Pareto sample: each text has inclusion odds of its own, which
grow with its size, texts are ranked by random odds over inclusion odds, and the rank
order is cut at the rest, so that the sample has a fixed size in tokens. The odds are
scaled so that the expected tokens are the rest, and come out with the mixture: a
statistic over texts is freed of their effect by weights 1 / inclusion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from archspan.llm.tokens import VOCABULARY, counter
from archspan.runtime import Scratch, spread

#: Inclusion odds grow with this power of a text's tokens; 0 gives all texts of a source equal odds.
SIZE_POWER = 0.5
#: Texts above this share of a source's rest are drawn first; the smaller ones then fill what is left.
LARGE_SHARE = 0.01
#: Buckets of the rank order per doubling, for the two-level prefix sum.
BUCKETS_PER_DOUBLING = 512


def _source(c: str) -> F.Column:
    return F.lower(F.trim(c))


def measured(documents: DataFrame, scratch: Scratch, vocabulary: str = VOCABULARY, seed: int = 0) -> DataFrame:
    """(doc_id, source, n_tokens, u): one row per distinct text, written once.

    Equal texts count as one text, kept under the row with the least doc_id, so that
    copies under several ids or sources can't pass the repeat cap. ``u`` is a uniform
    number drawn from the text's hash, the same in every run with one seed.
    """
    texts = documents.where(F.length("text") > 0).select("doc_id", _source("source").alias("source"), F.sha2("text", 256).alias("h"), "text")
    counted = spread(texts, documents).mapInArrow(counter(vocabulary, "text", ["doc_id", "source", "h"]), "doc_id bigint, source string, h string, n_tokens bigint")
    first = counted.groupBy("h").agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("_t"))
    u = (F.pmod(F.xxhash64("h", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return scratch.cut(first.select("_t.*", u.alias("u")).where("n_tokens > 0"))


def plan(texts: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> list[Row]:
    """Per listed source: tokens available, tokens wanted, whole copies and the share of a further one.

    The driver holds one row per listed source. Listed sources without text get
    nothing and the shares of the others are scaled up alike; unlisted sources are
    left out. Without ``total_tokens`` the mixture is the largest that meets all
    shares under the caps; with it, a source that is too small gives all it may.
    """
    listed = targets.select(_source("source").alias("source"), "target_share", "max_repeats")
    have = texts.groupBy("source").agg(F.sum("n_tokens").alias("available"), F.count(F.lit(1)).alias("n_texts"))
    rows = [r.asDict() for r in listed.join(have, "source", "left").orderBy("source").collect()]
    usable = [r for r in rows if r["available"] and r["target_share"] and r["target_share"] > 0 and r["max_repeats"] and r["max_repeats"] > 0]
    mass = sum(r["target_share"] for r in usable)
    if total_tokens is None:
        total_tokens = min((r["available"] * r["max_repeats"] / (r["target_share"] / mass) for r in usable), default=0)
    for r in rows:
        ok = r in usable
        r["wanted"] = min(int(total_tokens * r["target_share"] / mass), r["available"] * r["max_repeats"]) if ok else 0
        r["whole"] = r["wanted"] // r["available"] if ok else 0
        r["rest"] = r["wanted"] - r["whole"] * r["available"] if ok else 0
    return [Row(**r) for r in rows]


def _weight(power: float) -> Column:
    return F.pow(F.col("n_tokens").cast("double"), F.lit(float(power)))


def inclusion_scales(texts: DataFrame, rests: dict[str, int], scratch: Scratch, power: float = SIZE_POWER) -> dict[str, float]:
    """Per source the factor c for which the expected tokens, the sum of n_tokens * min(1, c * weight), are its rest.

    Texts whose odds would pass 1 are certain; the factor of the others rises until no
    further text does. Works on counts per text size; the driver holds one number per source.
    """
    spark = texts.sparkSession
    sizes = scratch.cut(texts.where(F.col("source").isin(*rests)).groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("k")))
    scales, certain = dict.fromkeys(rests, 0.0), dict.fromkeys(rests, -1)
    while rests:
        now = spark.createDataFrame(list(scales.items()), "source string, c double")
        sure = F.col("c") * _weight(power) >= 1
        rows = sizes.join(F.broadcast(now), "source").groupBy("source").agg(F.sum(F.when(sure, F.col("k") * F.col("n_tokens")).otherwise(0)).alias("sure"), F.sum(F.when(~sure, F.col("k") * F.col("n_tokens") * _weight(power)).otherwise(0.0)).alias("mass")).collect()
        if all(certain[r.source] == r.sure for r in rows):
            break
        certain.update({r.source: r.sure for r in rows})
        scales.update({r.source: max(0.0, rests[r.source] - r.sure) / r.mass for r in rows if r.mass > 0})
    return scales


def pareto_sample(texts: DataFrame, rests: dict[str, int], scales: dict[str, float], power: float = SIZE_POWER) -> DataFrame:
    """(doc_id, source, n_tokens, inclusion) of each source's texts in Pareto order, cut at its rest.

    A text has inclusion odds pi / (1 - pi) with pi = min(1, c * weight), and the random odds
    u / (1 - u). Ranks rise with random over inclusion odds. The text at which the rest is
    passed is taken if that misses the rest by less, so a source misses it by at most
    half of one text. The order is cut into buckets of the logarithm of the ratio;
    bucket sums are prefixed per source and texts within a bucket, so no task orders a whole source.
    """
    table = texts.sparkSession.createDataFrame([(s, int(r), float(scales[s])) for s, r in rests.items()], "source string, rest bigint, c double")
    pi = F.least(F.lit(1.0), F.col("c") * _weight(power))
    odds = F.when(F.col("inclusion") >= 1, 0.0).otherwise(F.col("u") / (1 - F.col("u")) * (1 - F.col("inclusion")) / F.col("inclusion"))
    bucket = F.when(F.col("q") <= 0, F.lit(-(1 << 30))).otherwise(F.floor(F.log2("q") * BUCKETS_PER_DOUBLING).cast("int"))
    ranked = texts.join(F.broadcast(table), "source").withColumn("inclusion", pi).where("inclusion > 0").withColumn("q", odds).withColumn("bucket", bucket)
    sums = ranked.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens"))
    base = sums.select("source", "bucket", F.coalesce(F.sum("tokens").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    near = ranked.join(base, ["source", "bucket"]).where(F.col("base") < F.col("rest"))
    upto = F.col("base") + F.sum("n_tokens").over(W.partitionBy("source", "bucket").orderBy("q", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow))
    over = F.col("upto") - F.col("rest")
    return near.withColumn("upto", upto).where((over <= 0) | (over < F.col("n_tokens") - over)).select("doc_id", "source", "n_tokens", "inclusion")


def draw(texts: DataFrame, rests: dict[str, int], scratch: Scratch, power: float = SIZE_POWER) -> DataFrame:
    """(doc_id, source, n_tokens, inclusion): the Pareto sample of each source, large texts first.

    Large texts are sampled to their own expected tokens; the smaller ones get exactly what these
    left of the rest, with odds scaled to it. So a source with smaller texts misses its rest
    by at most half a percent of it (LARGE_SHARE / 2), however long its longest texts are.
    """
    spark = texts.sparkSession
    scales = inclusion_scales(texts, rests, scratch, power)
    table = F.broadcast(spark.createDataFrame([(s, int(r), float(scales[s])) for s, r in rests.items()], "source string, rest bigint, c double"))
    placed = texts.join(table, "source").withColumn("large", F.col("n_tokens") > F.col("rest") * LARGE_SHARE)
    part = lambda large: placed.where("large" if large else "NOT large").select(*texts.columns)
    expected = placed.where("large").groupBy("source").agg(F.sum(F.least(F.lit(1.0), F.col("c") * _weight(power)) * F.col("n_tokens")).alias("tokens"))
    budget = {r.source: round(r.tokens) for r in expected.collect()}
    first = scratch.cut(pareto_sample(part(True), budget, scales, power))
    used = {r.source: r.tokens for r in first.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).collect()}
    left = {s: r - used.get(s, 0) for s, r in rests.items() if r > used.get(s, 0)}
    return first.unionByName(pareto_sample(part(False), left, inclusion_scales(part(False), left, scratch, power), power))


def mixture(documents: DataFrame, targets: DataFrame, scratch: Scratch, total_tokens: int | None = None, vocabulary: str = VOCABULARY, power: float = SIZE_POWER, seed: int = 0) -> DataFrame:
    """(doc_id, source, n_tokens, copies, inclusion): the texts of the mixture and how often each is used.

    copies is never above the source's max_repeats; inclusion is the chance with which
    the text got a copy beyond the whole ones, null where it got none. Null and empty texts are left
    out. Sources compare without case and outer blanks. Empty inputs give an empty mixture.
    """
    spark = documents.sparkSession
    texts = measured(documents, scratch, vocabulary, seed)
    rows = plan(texts, targets, total_tokens)
    shares = spark.createDataFrame([(r.source, int(r.whole)) for r in rows if r.wanted], "source string, whole bigint")
    ranked = texts.join(F.broadcast(shares), "source")
    rests = {r.source: r.rest for r in rows if r.rest > 0}
    picked = draw(texts, rests, scratch, power).select("doc_id", F.lit(1).alias("extra"), "inclusion")
    copies = (F.col("whole") + F.coalesce("extra", F.lit(0))).cast("int")
    return ranked.join(picked, "doc_id", "left").withColumn("copies", copies).where("copies > 0").select("doc_id", "source", "n_tokens", "copies", "inclusion")


def actual_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, n_texts, used_tokens, most_copies, actual_share, deviation) for every listed source.

    ``deviation`` is the actual share less the target, scaled up to the sources that have text at all.
    """
    used = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n_texts"), F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"), F.max("copies").alias("most_copies"))
    listed = targets.select(_source("source").alias("source"), "target_share", "max_repeats").join(used, "source", "left").fillna(0, ["n_texts", "used_tokens", "most_copies"])
    total = listed.agg(F.sum("used_tokens").alias("total"), F.sum(F.when(F.col("used_tokens") > 0, F.col("target_share"))).alias("mass"))
    share = F.coalesce(F.try_divide("used_tokens", "total"), F.lit(0.0))
    wanted = F.when(F.col("used_tokens") > 0, F.try_divide("target_share", "mass")).otherwise(F.lit(0.0))
    return listed.crossJoin(F.broadcast(total)).withColumn("actual_share", share).withColumn("deviation", share - wanted).drop("total", "mass")
