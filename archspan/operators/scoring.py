"""Scores of extracted rules against gold, arm comparison, confusion and rank statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from archspan.functions import names

#: Metrics of the arm comparison: their place in a report and which way is better; 0 is shown but moves no decision.
METRICS = {
    "ing_exact": ("ingestion.exact", 1),
    "ing_partial": ("ingestion.partial", 1),
    "ing_miss": ("ingestion.miss", -1),
    "ing_fp": ("ingestion.false_positives", -1),
    "ing_total": ("ingestion.total", 0),
    "presence_exact": ("ingestion.class_split.presence.exact", 1),
    "presence_miss": ("ingestion.class_split.presence.miss", -1),
    "scope_exact": ("ingestion.class_split.scope.exact", 1),
    "scope_miss": ("ingestion.class_split.scope.miss", -1),
    "det_exact": ("detection.exact", 1),
    "det_total": ("detection.total", 0),
}


def _related(a: Column, b: Column, x: Column, y: Column) -> Column:
    """2 exact, 1 partial (same base, or one base above the other), 0 miss; a, b are the patterns and x, y their bases."""
    return F.when(a == b, 2).when((x == y) | x.startswith(F.concat(y, F.lit("."))) | y.startswith(F.concat(x, F.lit("."))), 1).otherwise(0)


def rule_scores(gold: DataFrame, store: DataFrame) -> DataFrame:
    """(repo_id, adr_no, subject, predicate, object, score): best score of each gold rule against the store's rules of its ADR and predicate.

    The score is the lesser of subject and object: exact, partial or miss. Candidate
    pairs are found by equality on ancestors of the subject, so unrelated rules of an ADR never meet.
    """
    key = ["repo_id", "adr_no", "predicate"]
    g = gold.select(*key, "subject", "object").distinct().withColumn("gb", names.strip_dots_stars("subject"))
    s = store.select(*key, F.col("subject").alias("s_subject"), F.col("object").alias("s_object")).distinct().withColumn("sb", names.strip_dots_stars("s_subject"))
    up = g.withColumn("sb", F.explode(names.ancestors("gb"))).join(s, [*key, "sb"])
    down = s.withColumn("gb", F.explode(names.ancestors("sb", proper=True))).join(g, [*key, "gb"])
    pairs = up.select(*key, "subject", "object", "s_subject", "s_object", "gb", "sb").unionByName(down.select(*key, "subject", "object", "s_subject", "s_object", "gb", "sb"))
    both = F.least(_related(F.col("subject"), F.col("s_subject"), F.col("gb"), F.col("sb")), _related(F.col("object"), F.col("s_object"), names.strip_dots_stars("object"), names.strip_dots_stars("s_object")))
    best = pairs.withColumn("_s", both).groupBy(*key, "subject", "object").agg(F.max("_s").alias("_s"))
    score = F.coalesce(F.element_at(F.array(F.lit("miss"), F.lit("partial"), F.lit("exact")), F.coalesce("_s", F.lit(0)) + 1), F.lit("miss"))
    return g.drop("gb").join(best, [*key, "subject", "object"], "left").select("repo_id", "adr_no", "subject", "predicate", "object", score.alias("score"))


def accuracy(scores: DataFrame, *by: str) -> DataFrame:
    """Exact, partial and miss counts and (exact + partial / 2) / total, with the Wilson 95 % interval of the exact share."""
    n = F.count(F.lit(1))
    agg = scores.groupBy(*by).agg(*[F.count(F.when(F.col("score") == s, 1)).alias(s) for s in ("exact", "partial", "miss")], n.alias("total"))
    z = 1.959963984540054
    p, t = F.col("exact") / F.col("total"), F.col("total")
    mid, half, den = p + z * z / (2 * t), z * F.sqrt(p * (1 - p) / t + z * z / (4 * t * t)), 1 + z * z / t
    return agg.withColumn("accuracy", F.round((F.col("exact") + 0.5 * F.col("partial")) / t, 6)).withColumn("low", F.round((mid - half) / den, 6)).withColumn("high", F.round((mid + half) / den, 6))


def false_positives(gold: DataFrame, store: DataFrame) -> DataFrame:
    """(repo_id, adr_no, subject, predicate, object, account): each store rule is matched, fragment, tooling or false_positive, in this order.

    ``matched``: related to a gold rule of its ADR and predicate on both sides;
    ``fragment``: its subject lies under a gold subject of the same predicate in the
    repository and the object is related; ``tooling``: excluded by its scope.
    """
    key = ["repo_id", "predicate"]
    s = store.select("repo_id", "adr_no", "subject", "predicate", "object", "scope").distinct().withColumn("sb", names.strip_dots_stars("subject"))
    g = gold.select(*key, F.col("adr_no").alias("g_adr"), F.col("subject").alias("g_subject"), F.col("object").alias("g_object")).distinct().withColumn("gb", names.strip_dots_stars("g_subject"))
    rule = ["repo_id", "adr_no", "subject", "predicate", "object"]
    up = s.withColumn("gb", F.explode(names.ancestors("sb"))).join(g, [*key, "gb"])
    down = g.withColumn("sb", F.explode(names.ancestors("gb", proper=True))).join(s, [*key, "sb"]).where(F.col("adr_no") == F.col("g_adr"))
    cols = [*rule, "g_adr", "g_subject", "g_object", "gb", "sb"]
    pairs = up.select(*cols).unionByName(down.select(*cols))
    rel = _related(F.col("object"), F.col("g_object"), names.strip_dots_stars("object"), names.strip_dots_stars("g_object"))
    met = pairs.where(rel > 0).groupBy(*rule).agg(F.max((F.col("adr_no") == F.col("g_adr")).cast("int")).alias("m"), F.max((F.col("sb") != F.col("gb")).cast("int")).alias("f"))
    account = F.when(F.col("m") == 1, "matched").when(F.col("f") == 1, "fragment").when(F.col("scope") == "tooling", "tooling").otherwise("false_positive")
    return s.join(met, rule, "left").select(*rule, account.alias("account")).distinct()


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows left over on either side, as often as they are left over, with ``side``."""
    a = left.exceptAll(right).withColumn("side", F.lit("left"))
    return a.unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def cells(reports: DataFrame) -> DataFrame:
    """(repo_id, arm, run_index, metrics ..., parse_seconds): the last report of each cell; reports that are not JSON are left out."""

    def at(path: str) -> Column:
        return F.coalesce(F.get_json_object("payload", f"$.{path}"), F.get_json_object("payload", f"$.report.{path}"))

    metrics = {m: path for m, (path, _) in METRICS.items()}
    valid = reports.where(F.expr("try_parse_json(payload) IS NOT NULL")).select("repo_id", at("arm").alias("arm"), at("run_index").cast("int").alias("run_index"), "written_at", "report_id", *[at(p).cast("double").alias(m) for m, p in metrics.items()], at("cost.parse_seconds").cast("double").alias("parse_seconds"))
    keep = [*metrics, "parse_seconds"]
    return valid.groupBy("repo_id", "arm", "run_index").agg(F.max_by(F.struct(*keep), F.struct("written_at", "report_id")).alias("_c")).select("repo_id", "arm", "run_index", "_c.*")


def long_cells(cells_: DataFrame) -> DataFrame:
    """(repo_id, arm, run_index, metric, value) of the metrics that a run carries."""
    return cells_.select("repo_id", "arm", "run_index", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])).alias("_m")).select("repo_id", "arm", "run_index", "_m.*").where("value IS NOT NULL")


def arm_effects(long: DataFrame) -> DataFrame:
    """Per repository and metric: means of both arms, noise floor (spread within node_on), delta, consistent paired runs and the effect flag.

    An effect needs a delta beyond the floor that at least two paired runs share in sign.
    """
    on, off = long.where("arm = 'node_on'"), long.where("arm = 'node_off'")
    a = on.groupBy("repo_id", "metric").agg(F.avg("value").alias("mean_on"), (F.max("value") - F.min("value")).alias("floor"))
    b = off.groupBy("repo_id", "metric").agg(F.avg("value").alias("mean_off"))
    pairs = on.select("repo_id", "metric", "run_index", F.col("value").alias("v_on")).join(off.select("repo_id", "metric", "run_index", F.col("value").alias("v_off")), ["repo_id", "metric", "run_index"])
    signs = pairs.groupBy("repo_id", "metric").agg(F.count(F.when(F.col("v_on") > F.col("v_off"), 1)).alias("ups"), F.count(F.when(F.col("v_on") < F.col("v_off"), 1)).alias("downs"))
    d = a.join(b, ["repo_id", "metric"], "left").join(signs, ["repo_id", "metric"], "left").withColumn("delta", F.col("mean_on") - F.col("mean_off"))
    same = F.coalesce(F.when(F.col("delta") > 0, F.col("ups")).when(F.col("delta") < 0, F.col("downs")), F.lit(0))
    effect = F.coalesce((F.abs("delta") > F.col("floor")) & (same >= 2), F.lit(False))
    return d.select("repo_id", "metric", *[F.round(c, 6).alias(c) for c in ("mean_on", "mean_off", "floor", "delta")], same.alias("n_consistent"), effect.alias("effect"))


def arm_decision(effects: DataFrame) -> DataFrame:
    """(repo_id, decision): keep if an effect improves a metric, else cut_candidate if one worsens, else no_movement."""
    way = F.lit(0)
    for m, (_, d) in METRICS.items():
        way = F.when(F.col("metric") == m, F.lit(d)).otherwise(way)
    gain = F.when(F.col("effect"), F.signum("delta") * way)
    return effects.groupBy("repo_id").agg(F.max(gain).alias("up"), F.min(gain).alias("down")).select("repo_id", F.when(F.col("up") > 0, "keep").when(F.col("down") < 0, "cut_candidate").otherwise("no_movement").alias("decision"))


def cost_means(cells_: DataFrame) -> DataFrame:
    """(repo_id, arm, parse_seconds, n_runs): mean over the runs that report it, NaN where none does."""
    return cells_.groupBy("repo_id", "arm").agg(F.coalesce(F.round(F.avg("parse_seconds"), 6), F.lit(float("nan"))).alias("parse_seconds"), F.count(F.lit(1)).alias("n_runs"))


def upper_median(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Per group the value at position n div 2 of the sorted values (from 0), with least and greatest.

    Equal values are counted first, so the window runs over distinct values.
    """
    freq = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("k"))
    w = W.partitionBy(*by)
    placed = freq.withColumn("upto", F.sum("k").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("n", F.sum("k").over(w))
    return placed.groupBy(*by).agg(F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col(value))).alias("median"), F.min(value).alias("least"), F.max(value).alias("greatest"))


def fires_moved(old: DataFrame, new: DataFrame, keys: list[str], top: int | None = 40) -> DataFrame:
    """Keys whose number of rows differs, with both counts, the ``top`` by size of change (a top-k report), or all with None."""
    a = old.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_old"))
    b = new.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_new"))
    both = a.join(b, keys, "full").fillna(0, ["n_old", "n_new"]).where("n_old <> n_new")
    return both if top is None else both.orderBy(F.abs(F.col("n_new") - F.col("n_old")).desc(), *keys).limit(top)


def confusion(pairs: DataFrame) -> DataFrame:
    """(repo_id, expected, observed, n) per repository and over all (repo_id null)."""
    per = pairs.groupBy("repo_id", "expected", "observed").agg(F.count(F.lit(1)).alias("n"))
    all_ = per.groupBy("expected", "observed").agg(F.sum("n").alias("n"))
    return per.unionByName(all_.select(F.lit(None).cast("string").alias("repo_id"), "expected", "observed", "n"))


def recall(confused: DataFrame, label: str) -> DataFrame:
    """(repo_id, precision, recall) of one label; null where the denominator is zero."""
    hit = F.sum(F.when((F.col("expected") == label) & (F.col("observed") == label), F.col("n")).otherwise(0))
    pred, act = F.sum(F.when(F.col("observed") == label, F.col("n")).otherwise(0)), F.sum(F.when(F.col("expected") == label, F.col("n")).otherwise(0))
    return confused.groupBy("repo_id").agg(F.round(F.try_divide(hit, pred), 6).alias("precision"), F.round(F.try_divide(hit, act), 6).alias("recall"))


def rank_auc(scored: DataFrame) -> DataFrame:
    """(n_pos, n_neg, auc): chance that a positive scores above a negative, ties one half.

    Scores are counted per value first; the negatives below a score are a two-level
    prefix sum, over ranges of scores and within each, so that no task holds all scores.
    """
    freq = scored.where(F.col("score").isNotNull()).groupBy("score").agg(F.count(F.when(F.col("positive"), 1)).alias("p"), F.count(F.when(~F.col("positive"), 1)).alias("q"))
    span = freq.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    place = F.floor((F.col("score") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-300)) * SCORE_RANGES)
    dealt = freq.crossJoin(F.broadcast(span)).select("score", "p", "q", place.alias("range"))
    sums = dealt.groupBy("range").agg(F.sum("q").alias("range_q"))
    base = sums.select("range", F.coalesce(F.sum("range_q").over(W.partitionBy(F.lit(1)).orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("q").over(W.partitionBy("range").orderBy("score").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    below = dealt.withColumn("within", within).join(base, "range").withColumn("below", F.col("base") + F.col("within"))
    wins = below.agg(F.sum(F.col("p") * (F.col("below") + 0.5 * F.col("q"))).alias("w"), F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"))
    return wins.select("n_pos", "n_neg", F.round(F.try_divide("w", F.col("n_pos") * F.col("n_neg")), 6).alias("auc"))


#: Ranges of scores whose counts are prefixed in one task.
SCORE_RANGES = 4096


def reason_bucket(justification: Column, case_type: Column) -> Column:
    """Why a finding was dismissed, from the reviewer's words, else from the kind of case."""
    why = F.lower(F.coalesce(justification, F.lit("")))
    return (
        F.when(why.contains("pre-existing") | why.contains("preexisting"), "pre-existing")
        .when(why.contains("not a known violation") | why.contains("known violation set"), "not-in-known-set")
        .when(case_type.isin("compliant_probe", "clean_merged_commit"), "case-metadata")
        .otherwise("other")
    )


def zero_loss(scored: DataFrame) -> DataFrame:
    """One row (threshold, n_kept, dropped_neg, n): the highest threshold that drops no positive, and what it drops; null without positives."""
    floor = scored.where("positive").agg(F.min("score").alias("threshold"))
    both = scored.crossJoin(F.broadcast(floor))
    kept = F.count(F.when(F.col("score") >= F.col("threshold"), 1))
    return both.agg(F.max("threshold").alias("threshold"), kept.alias("n_kept"), F.count(F.when((F.col("score") < F.col("threshold")) & ~F.col("positive"), 1)).alias("dropped_neg"), F.count(F.lit(1)).alias("n"))


def threshold_sweep(scored: DataFrame, steps: int = 19) -> DataFrame:
    """(step, threshold, kept_pos, dropped_neg, precision): thresholds at even parts of the score range, over score counts."""
    freq = scored.groupBy("score").agg(F.count(F.when(F.col("positive"), 1)).alias("p"), F.count(F.when(~F.col("positive"), 1)).alias("q"))
    span = freq.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    grid = span.select(F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"), "lo", "hi").select("step", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("step") / (steps + 1)).alias("threshold"))
    at = freq.crossJoin(F.broadcast(grid))
    out = at.groupBy("step", "threshold").agg(F.sum(F.when(F.col("score") >= F.col("threshold"), F.col("p")).otherwise(0)).alias("kept_pos"), F.sum(F.when(F.col("score") < F.col("threshold"), F.col("q")).otherwise(0)).alias("dropped_neg"), F.sum(F.when(F.col("score") >= F.col("threshold"), F.col("p") + F.col("q")).otherwise(0)).alias("kept"))
    return out.select("step", F.round("threshold", 6).alias("threshold"), "kept_pos", "dropped_neg", F.round(F.try_divide("kept_pos", "kept"), 6).alias("precision"))


def survival(spans: DataFrame, *by: str) -> DataFrame:
    """Kaplan-Meier: (by ..., day, at_risk, ended, share) of spans with ``days`` and ``ended``.

    Days are counted first, so the windows run over distinct days per group.
    """
    freq = spans.groupBy(*by, "days").agg(F.count(F.lit(1)).alias("k"), F.count(F.when(F.col("ended"), 1)).alias("d"))
    w = W.partitionBy(*by).orderBy("days")
    risk = F.sum("k").over(W.partitionBy(*by)) - F.coalesce(F.sum("k").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = freq.withColumn("at_risk", risk).where("d > 0")
    log = F.when(F.col("d") < F.col("at_risk"), F.log(1 - F.col("d") / F.col("at_risk"))).otherwise(F.lit(-1e3))
    return placed.select(*by, F.col("days").alias("day"), "at_risk", F.col("d").alias("ended"), F.round(F.exp(F.sum(log).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))), 6).alias("share"))


def ratchet(scores: DataFrame, least: float, fp: DataFrame, most_fp: int) -> DataFrame:
    """One row (blended, n_fp, passed): the gate holds if exact + partial / 2 is at least ``least`` and false positives at most ``most_fp``."""
    blended = scores.agg(F.coalesce(F.sum(F.when(F.col("score") == "exact", 1.0).when(F.col("score") == "partial", 0.5).otherwise(0.0)), F.lit(0.0)).alias("blended"))
    n = fp.agg(F.count(F.when(F.col("account") == "false_positive", 1)).alias("n_fp"))
    return blended.crossJoin(F.broadcast(n)).withColumn("passed", (F.col("blended") >= least) & (F.col("n_fp") <= most_fp))
