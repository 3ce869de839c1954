"""Differences between two copies of data (problem 2).

Both copies are collapsed to one row per key and written, cogrouped by hash bucket
as Arrow tables, aligned by sorted search over key hashes and compared through
null-aware masks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archspan.runtime import Scratch

#: Keys of both copies per bucket, about; the number of buckets follows the number of keys.
KEYS_PER_BUCKET = 50_000


def _collapse(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row per key (as one text, nulls marked, and its hash): per field i the least value (v), the number of values (n, null included) and a digest of the set of values (d).

    Rows become cells, and equal cells of a key meet before the key does: a key with
    very many rows is spread over its values.
    """
    key = F.to_json(F.struct(*[F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)]))
    cells = df.select(key.alias("key"), F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f).cast("string").alias("v")) for i, f in enumerate(fields)])).alias("c"))
    distinct = cells.select("key", "c.f", "c.v").distinct()
    out = []
    for i in range(len(fields)):
        mine = F.col("f") == i
        out += [F.min(F.when(mine, F.col("v"))).alias(f"v{i}"), F.count(F.when(mine, 1)).alias(f"n{i}"), F.bit_xor(F.when(mine, F.xxhash64("v", F.col("v").isNull()))).alias(f"d{i}")]
    return distinct.groupBy("key").agg(*out).withColumn("hash", F.xxhash64("key"))


def _aligned(lt: pa.Table, rt: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the keys in both (left, right), only left and only right; keys are unique within a side.

    Hashes are aligned; the texts decide. Where two keys share a hash, the rows are
    aligned anew by the numbers of a dictionary over the texts.
    """
    lh, rh = lt["hash"].to_numpy(), rt["hash"].to_numpy()
    il, ir, ol, orr = _align(lh, rh)
    unique = len(np.unique(lh)) == len(lh) and len(np.unique(rh)) == len(rh)
    if unique and pc.all(pc.equal(lt["key"].take(pa.array(il)), rt["key"].take(pa.array(ir)))).as_py() is not False:
        return il, ir, ol, orr
    codes = pa.chunked_array([*lt["key"].chunks, *rt["key"].chunks], pa.string()).combine_chunks().dictionary_encode().indices.to_numpy()
    return _align(codes[: len(lt)], codes[len(lt) :])


def _align(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted search of the left numbers among the right ones."""
    order = np.argsort(right, kind="stable")
    if not len(order):
        none = np.array([], dtype=np.int64)
        return none, none, np.arange(len(left)), none
    at = np.searchsorted(right[order], left)
    found = order[np.minimum(at, len(order) - 1)]
    same = right[found] == left
    only_right = np.ones(len(right), dtype=bool)
    only_right[found[same]] = False
    return np.flatnonzero(same), found[same], np.flatnonzero(~same), np.flatnonzero(only_right)


def _differs(a: pa.Table, b: pa.Table, i: int) -> np.ndarray:
    """Null-aware mask of field i over aligned rows: a null equals a null and nothing else; sets of values compare by digest."""
    va, vb = a[f"v{i}"], b[f"v{i}"]
    na, nb = pc.is_null(va).to_numpy(zero_copy_only=False), pc.is_null(vb).to_numpy(zero_copy_only=False)
    unequal = pc.fill_null(pc.not_equal(va, vb), False).to_numpy(zero_copy_only=False)
    many = (a[f"n{i}"].to_numpy() > 1) | (b[f"n{i}"].to_numpy() > 1)
    sets = (a[f"n{i}"].to_numpy() != b[f"n{i}"].to_numpy()) | (a[f"d{i}"].to_numpy() != b[f"d{i}"].to_numpy())
    return np.where(many, sets, (na != nb) | unequal)


def _cells(key: pa.ChunkedArray, name: str, left: pa.ChunkedArray | None, right: pa.ChunkedArray | None) -> pa.Table:
    none = pa.nulls(len(key), pa.string())
    return pa.table({"key": key, "field_name": pa.array([name] * len(key), pa.string()), "left_value": none if left is None else left, "right_value": none if right is None else right})


def diff_copies(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str], only_left: str = "missing_in_right", only_right: str = "missing_in_left", buckets: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """One row per difference: the keys, ``field_name``, ``left_value`` and ``right_value`` (strings).

    Keys compare null-safe. Repeated rows count once; where a key has several rows
    with other values, a field differs if the two sets of its values do (the least
    values are shown). Columns other than keys and fields are ignored, so clashing names do no harm; fields
    compare by their string form. An empty copy makes every key of the other missing.
    """
    types = {k: dict(left.select(*keys).dtypes)[k] for k in keys}
    scratch = scratch or Scratch(left.sparkSession, "copies")
    (a, n_left), (b, n_right) = (scratch.cut_counting(_collapse(df, keys, fields), F.lit(True)) for df in (left, right))
    if buckets is None:
        buckets = max(8, -(-(n_left + n_right) // KEYS_PER_BUCKET))

    def compare(lt: pa.Table, rt: pa.Table) -> pa.Table:
        il, ir, ol, orr = _aligned(lt, rt)
        at, bt = lt.take(pa.array(il)), rt.take(pa.array(ir))
        cells = [_cells(lt["key"].take(pa.array(ol)), only_left, None, None), _cells(rt["key"].take(pa.array(orr)), only_right, None, None)]
        for i, f in enumerate(fields):
            mask = pa.array(_differs(at, bt, i))
            cells.append(_cells(at["key"].filter(mask), f, at[f"v{i}"].filter(mask), bt[f"v{i}"].filter(mask)))
        return pa.concat_tables(cells)

    a, b = (df.withColumn("bucket", F.pmod("hash", F.lit(buckets))) for df in (a, b))
    found = a.groupBy("bucket").cogroup(b.groupBy("bucket")).applyInArrow(compare, "key string, field_name string, left_value string, right_value string")
    parsed = F.from_json("key", ", ".join(f"k{i} string" for i in range(len(keys))))
    return found.withColumn("_k", parsed).select(*[F.col(f"_k.k{i}").cast(types[k]).alias(k) for i, k in enumerate(keys)], "field_name", "left_value", "right_value")


def adr_number(adr_id: str) -> Column:
    """The number in an ADR id, however it is written; null without digits."""
    return F.expr(f"try_cast(regexp_extract({adr_id}, '[0-9]+', 0) AS bigint)")


RULE = ["repo_id", "adr_no", "subject", "predicate", "object"]
TEXTS = ["justification", "scope", "adr_path"]


def normal_rules(rules: DataFrame) -> DataFrame:
    """Rule key and texts as they are compared."""
    return rules.select(
        "repo_id",
        adr_number("adr_id").alias("adr_no"),
        F.trim("subject").alias("subject"),
        "predicate",
        F.trim("object").alias("object"),
        F.trim(F.regexp_replace("justification", r"\s+", " ")).alias("justification"),
        F.lower(F.coalesce("scope", F.lit("runtime"))).alias("scope"),
        "adr_path",
    )


def gold_rules(gold: DataFrame) -> DataFrame:
    """Rules of the nested ADR records; ADRs with empty or null lists and null list elements give none."""
    flat = gold.select("repo_id", "adr_id", "adr_path", F.explode("constraints").alias("_r")).where(F.col("_r").isNotNull())
    return flat.select("repo_id", "adr_id", "adr_path", *[F.col(f"_r.{f}").alias(f) for f in ("subject", "predicate", "object", "justification", "scope")])


def rule_differences(gold: DataFrame, store: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Differences between the gold rules and the store's copy, with both values."""
    return diff_copies(normal_rules(gold_rules(gold)), normal_rules(store), RULE, TEXTS, only_left="missing_in_store", only_right="missing_in_gold", scratch=scratch)


def contradicted_flags(seeds: DataFrame, differences: DataFrame) -> DataFrame:
    """(repo_id, adr_no) of seed records whose non-null flag differs from "no rule is missing on either side"."""
    missing = differences.where(F.col("field_name").isin("missing_in_store", "missing_in_gold")).select("repo_id", "adr_no").distinct().withColumn("_missing", F.lit(True))
    flags = seeds.where(F.col("matches_gold").isNotNull()).select("repo_id", adr_number("adr_id").alias("adr_no"), "matches_gold").distinct()
    joined = flags.join(missing, ["repo_id", "adr_no"], "left")
    return joined.where(F.col("matches_gold") == F.coalesce("_missing", F.lit(False))).select("repo_id", "adr_no")


def found(gold: DataFrame, store: DataFrame, seeds: DataFrame) -> DataFrame:
    """All differences and contradicted flags in one list, distinct."""
    scratch = Scratch(store.sparkSession, "differences")
    diffs = scratch.cut(rule_differences(gold, store, scratch))
    blank = F.lit("")
    flags = contradicted_flags(seeds, diffs).select("repo_id", "adr_no", blank.alias("subject"), blank.alias("predicate"), blank.alias("object"), F.lit("matches_gold").alias("field_name"))
    return diffs.select(*RULE, "field_name").unionByName(flags).distinct()
