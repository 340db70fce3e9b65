"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

Sources by code point, null last, take the weights in turn and share the words of the whole corpus; a source's target
stops at CAP times its words and the excess goes to the others by weight until none is above. In closed form: sources
by the ratio of cap to weight fill up in that order, and all that are not full share one level.

A target is whole repetitions of the source and a remainder. The remainder takes documents in a seeded order until
its words are taken; the one on the edge gives its first words. The order is that of an MD5 digest, by buckets: bucket sums give the
bucket that the edge lies in, and only that bucket's documents are ordered, so no source is ever sorted or collected.
One row per source meets in one task; documents never do.

Defined cases: null or empty text has size 0 and takes 0; a null source is a source of its own; a source without words
has target 0; rows that repeat each other are documents each; the order is of doc_id and text, so reruns agree;
a null doc_id is ordered by its text alone; ties in the order are equal rows; other columns pass through; an empty table
gives no rows; a very long text is counted in the memory of its row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlens.llm.common import Scratch, aside, bounded

WEIGHTS, CAP, SEED = (5, 2, 1), 3, 20240607
ADDED = ("_size", "_source_size", "_target", "_whole", "_part")
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sources(source, source_size) with target and the whole repetitions and remaining words that make it."""
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = reduce(lambda c, k: c.when(turn == k, float(weights[k])), range(1, len(weights)), F.when(turn == 0, float(weights[0])))
    at = sources.withColumn("weight", weight).withColumn("most", cap * F.col("source_size").cast("double"))
    up = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, all_rows = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum(F.col("source_size").cast("double")).over(all_rows) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    share = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    at = at.withColumn("level", left / share).withColumn("full", F.col("most") <= F.col("level") * F.col("weight"))
    first = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(all_rows)
    at = at.withColumn("target", F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * first))
    at = at.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    rest = F.round("target").cast("long") - F.col("whole") * F.col("source_size")
    return at.select("source", "source_size", "target", "whole", F.greatest(F.lit(0), F.least(rest, "source_size")).alias("rest"))


def _mix(rows: DataFrame, names: dict[str, str], weights: tuple[int, ...], cap: int, seed: int) -> DataFrame:
    s = Scratch(rows.sparkSession)
    source = F.col(names["source"])
    text = lambda c: F.coalesce(F.col(names[c]).cast("string"), F.lit(""))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), text("doc_id"), text("text")))
    size = word_count(F.col(names["text"]).cast("string"))
    keyed = rows.withColumn("_order", order).withColumn("_bucket", F.conv(F.substring("_order", 1, 3), 16, 10).cast("int"))
    sums = s.cut(keyed.withColumn("_size", size).groupBy(source.alias("source"), "_bucket").agg(F.sum("_size").alias("words")), "buckets", True)
    filled = s.cut(targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap), "targets", True)
    run = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    runs = sums.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
    level = filled.select(F.col("source").alias("_s"), F.col("rest").alias("_rest"))
    edge = runs.join(level, F.col("source").eqNullSafe(F.col("_s"))).where("before <= _rest")
    edge = edge.groupBy("_s").agg(F.max(F.struct("_bucket", "before")).alias("e"))
    facts = filled.join(edge, F.col("source").eqNullSafe(F.col("_s")), "left").select(
        F.col("source").alias("_s"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.col("whole").alias("_whole"),
        F.col("rest").alias("_rest"), F.col("e._bucket").alias("_edge"), F.col("e.before").alias("_before"),
    )
    facts = s.finish(facts)
    # One row per source, broadcast if its size allows. Words are counted below the join, where no later step counts them
    # again; of the documents on the edge only, above the filter that picks them.
    facts, same = bounded(facts), source.eqNullSafe(F.col("_s"))
    sure = keyed.withColumn("_size", size).join(facts, same).where("_bucket <> _edge")
    sure = sure.withColumn("_part", F.when(F.col("_bucket") < F.col("_edge"), F.col("_size")).otherwise(F.lit(0)).cast("long"))
    inside = Window.partitionBy("_s").orderBy("_order", names["doc_id"]).rowsBetween(Window.unboundedPreceding, -1)
    near = keyed.join(facts, same).where("_bucket = _edge").withColumn("_size", size)
    near = near.withColumn("_taken", F.coalesce(F.sum("_size").over(inside), F.lit(0)) + F.col("_before"))
    near = near.withColumn("_part", F.greatest(F.lit(0), F.least("_size", F.col("_rest") - F.col("_taken"))).cast("long")).drop("_taken")
    return sure.unionByName(near).select(*rows.columns, *ADDED)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """docs with _size, _source_size, _target, _whole (repetitions) and _part (words of a fractional one)."""
    return _mix(*aside(docs), weights, cap, seed).toDF(*docs.columns, *ADDED)


def mixed_texts(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """The documents that the mix takes, columns as in docs: a document's repetitions stand in its text, a line break
    between them, so that doc_id stays a key; a fractional one is its first words."""
    rows, names = aside(docs)
    out, text = _mix(rows, names, weights, cap, seed).where("_whole * _size + _part > 0"), names["text"]
    some = F.when(F.col("_part") == F.col("_size"), F.array(text)).when(
        F.col("_part") > 0, F.array(F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), 1, F.col("_part").cast("int")), " "))
    )
    parts = F.concat(F.array_repeat(text, F.col("_whole").cast("int")), F.coalesce(some, F.array().cast("array<string>")))
    out = out.withColumn(text, F.array_join(parts, "\n"))
    if "n_chars" in names:
        out = out.withColumn(names["n_chars"], F.char_length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*rows.columns).toDF(*docs.columns)
