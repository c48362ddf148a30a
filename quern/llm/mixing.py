"""Mixing sources to target weights by pivotal dependent rounding.

A source whose target is r times its size takes floor(r) copies of each document and rounds the fraction
r - floor(r) of each document to 0 or 1. Documents meet in pairs and transfer words: one gains what the
other loses, until one of the two is integral; which way is drawn so that each keeps its expectation.
The words of a pair do not change, so a source ends within one document of its target. Buckets of
documents are rounded apart, and the at most one undecided document of each goes up a reduction tree,
level by level, to the source's last one.

Equal rows are counted before they are shuffled and numbered by their count, so that repeats, however many,
spread over buckets like other documents and need no rank among each other.

Defined results: null and empty texts have size 0 and take 0; a null source is a source, after all
others; a source of size 0 has target 0. Repeated rows are documents of their own. Draws depend on the
rows of a bucket and a seed only, so reruns agree, whatever the partitions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch

#: No document is taken more than so often.
MOST = 3
#: Weights of the sources in order, repeating.
WEIGHTS = (1, 2, 3)
#: Rows of a bucket, and residuals that one node of the tree combines, about.
BUCKET = 4096
FAN = 256
_ROUNDED = "key string, again bigint, size bigint, rank bigint, bucket bigint, copies int, p double"


def _numbered(df: DataFrame, order, scratch: Scratch, name: str, *sums: str) -> DataFrame:
    """df in the order asked for, written, with `rank` and, for each column named, the sum of it over all rows before.

    What the driver holds is a row a partition, whatever the number of rows.
    """
    ordered = scratch.keep(df.orderBy(*order).withColumn("at", F.monotonically_increasing_id()), name)
    ordered = ordered.withColumn("part", F.shiftrightunsigned("at", 33))
    parts = ordered.groupBy("part").agg(F.count("*").alias("rank"), *[F.sum(c).alias(c) for c in sums]).orderBy("part").collect()
    names, first, offsets = ("rank", *sums), [0] * (1 + len(sums)), []
    for r in parts:
        offsets.append((r["part"], *first))
        first = [x + (r[c] or 0) for x, c in zip(first, names, strict=True)]
    offsets = df.sparkSession.createDataFrame(offsets, "part bigint, _rank bigint" + "".join(f", _{c} bigint" for c in sums))
    before = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    out = ordered.join(offsets, "part").withColumn("rank" if "rank" not in df.columns else "_place", F.col("_rank") + inside)
    for c in sums:
        out = out.withColumn(f"{c}_before", F.col(f"_{c}") + F.coalesce(F.sum(c).over(before), F.lit(0)))
    return out.drop("part", "at", "_rank", "_place", *[f"_{c}" for c in sums])


def source_targets(sized: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, rank, n, source_size, target: shares of all sizes by weight, capped, the excess reshared.

    sized: source, size, m (rows of that size). By ascending cap a unit of weight, a source is capped if the level
    that the capped ones before it leave is above its own; so one pass over sorted sums finds all of them.
    """
    sums = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.sum("m").alias("n"))
    ranked = _numbered(sums, [F.asc_nulls_last("source")], scratch, "sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int") + 1)
    ranked = scratch.keep(ranked.select("source", "rank", "n", "source_size", weight.cast("bigint").alias("weight"), (F.col("source_size") * most).alias("cap")), "ranked")
    total = ranked.agg(F.sum("source_size").alias("t"), F.sum("weight").alias("w")).first()
    t, w = total["t"] or 0, total["w"] or 0
    if not w:
        return ranked.withColumn("target", F.lit(0.0))
    full = _numbered(ranked, [F.col("cap") / F.col("weight"), "rank"], scratch, "by-cap", "cap", "weight")
    full = full.filter((F.lit(t) - F.col("cap_before")) * F.col("weight") > F.col("cap") * (F.lit(w) - F.col("weight_before")))
    x = full.agg(F.sum("cap").alias("cap"), F.sum("weight").alias("w")).first()
    left = w - (x["w"] or 0)
    level = (t - (x["cap"] or 0)) / left if left else float("inf")
    return ranked.withColumn("target", F.when(F.col("cap") == 0, 0.0).otherwise(F.least(F.col("weight") * F.lit(level), F.col("cap").cast("double"))))


def _round(rows: pd.DataFrame, seed: int, level: int) -> pd.DataFrame:
    """Pivotal rounding of one bucket: all rows but at most one get their `copies`; the one left keeps a p."""
    rows = rows.sort_values(["key", "again", "size", "p"], kind="stable", ignore_index=True)
    rank, bucket = int(rows["rank"].iloc[0]), int(rows["bucket"].iloc[0])
    rng = np.random.default_rng([seed, level, rank, bucket & 0xFFFFFFFF, bucket >> 32])
    rows = rows.iloc[rng.permutation(len(rows))].reset_index(drop=True)
    sizes, p, draws = rows["size"].tolist(), rows["p"].tolist(), rng.random(len(rows)).tolist()
    i = 0
    for j in range(1, len(rows)):
        a, b = sizes[i], sizes[j]
        up, down = min(a * (1 - p[i]), b * p[j]), min(a * p[i], b * (1 - p[j]))
        gain = draws[j] * (up + down) < down
        move = up if gain else -down
        # the one that meets its bound is set to it exactly
        mine = a * (1 - p[i]) <= b * p[j] if gain else a * p[i] <= b * (1 - p[j])
        if mine:
            p[j], p[i] = min(1.0, max(0.0, p[j] - move / b)), float(gain)
        else:
            p[i], p[j] = min(1.0, max(0.0, p[i] + move / a)), float(not gain)
        if p[i] in (0.0, 1.0):
            i = j
    rows["p"] = p
    whole = rows["p"].isin((0.0, 1.0))
    rows["copies"] = rows["copies"] + np.where(whole & (rows["p"] == 1.0), 1, 0).astype("int32")
    rows.loc[whole, "p"] = np.nan
    return rows


def _rounding(seed: int, level: int):
    return lambda rows: _round(rows, seed, level)


def drawn(rows: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 7) -> DataFrame:
    """key, size, source_size, target, copies of each row of (key string, source, text): equal rows share a key, but not a draw."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = scratch.keep(rows.select("key", "source", size.alias("size")).groupBy("key", "source", "size").agg(F.count("*").alias("m")), "sized")
    targets = scratch.keep(source_targets(sized, scratch, weights, most), "targets")
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    buckets = F.ceil(F.col("n") / BUCKET)
    units = (
        sized.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
        .select("key", "size", "rank", "n", ratio.alias("r"), F.explode(F.sequence(F.lit(1).cast("bigint"), "m")).alias("again"))
        .select("key", "again", "size", "rank", F.pmod(F.xxhash64("key", "again", "size"), buckets).alias("bucket"), F.floor("r").cast("int").alias("copies"), (F.col("r") - F.floor("r")).alias("p"))
    )
    settled = (F.col("size") == 0) | (F.col("p") == 0)
    done = [units.filter(settled).withColumn("p", F.lit(None).cast("double"))]
    open_, levels = units.filter(~settled), 0
    wide = targets.agg(F.max(F.ceil(F.col("n") / BUCKET)).alias("n")).first()["n"] or 1
    while True:
        rounded = open_.groupBy("rank", "bucket").applyInPandas(_rounding(seed, levels), _ROUNDED)
        rounded = scratch.keep(rounded, f"level{levels}")
        done.append(rounded.filter("p is null"))
        left = rounded.filter("p is not null")
        levels += 1
        if wide <= 1:
            break
        wide = -(-wide // FAN)
        open_ = left.withColumn("bucket", F.floor(F.col("bucket") / FAN))
    # the last one of a source: by the same kind of draw, its expectation kept
    draw = F.pmod(F.xxhash64(F.lit(seed), "rank", "key", "again"), F.lit(1 << 30)) / float(1 << 30)
    done.append(left.withColumn("copies", F.col("copies") + (draw < F.col("p")).cast("int")).withColumn("p", F.lit(None).cast("double")))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.join(targets.select("rank", "source_size", "target"), "rank").select("key", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of each document."""
    rows = docs.select(F.col("doc_id").cast("string").alias("key"), "source", "text")
    out = drawn(rows, Scratch(docs.sparkSession, "mixing"), weights, most, seed)
    return out.select(F.col("key").cast("bigint").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 7) -> DataFrame:
    """Each row of docs as often as the mix takes it: equal rows together as often as all of them are taken."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.md5(F.to_json(F.struct(*columns))).alias("key"), F.struct(*columns).alias("row"), "source", "text")
    taken = drawn(keyed.select("key", "source", "text"), Scratch(docs.sparkSession, "mixing"), weights, most, seed)
    total = taken.groupBy("key").agg(F.sum("copies").cast("int").alias("copies")).filter("copies > 0")
    # equal rows are one before they are shuffled
    one = keyed.groupBy("key").agg(F.first("row").alias("row"))
    return one.join(total, "key").select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("again")).select("row.*")
