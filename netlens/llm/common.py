"""What the operators share: the shared scratch folder and connected components."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.sources.files import checkpointed, remove, shared_folder

#: Bytes that a broadcast side may take, as measured.
BROADCAST = 32 << 20


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no recomputation of what was cut."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def path(self, name: str) -> str:
        out = f"{shared_folder(self.spark)}/netlens-{name}-{uuid.uuid4().hex}"
        self.paths.append(out)
        return out

    def cut(self, df: DataFrame, name: str, small: bool = False, of_many: bool = False) -> DataFrame:
        """The table written and read again. small: a table of ids behind a shuffle; it goes to no more files than
        twice the cluster's cores, as every file costs a process and a listing. of_many: a small one that is made of
        very many rows; it is dealt anew first, so that few files don't mean few tasks that read those."""
        out = self.path(name)
        if of_many:
            df = df.hint("rebalance")
        if small:
            df = df.coalesce(max(16, 2 * self.spark.sparkContext.defaultParallelism))
        schema = df.schema
        df.write.parquet(out)
        return self.spark.read.schema(schema).parquet(out)

    def clear(self) -> None:
        """Delete all tables."""
        for out in self.paths:
            remove(self.spark, out)
        self.paths = []

    def keep(self, df: DataFrame) -> DataFrame:
        """The table as a checkpoint in the shared folder. It needs no other table any more, and Spark's cleaner deletes
        it when nothing refers to it (spark.cleaner.referenceTracking.cleanCheckpoints)."""
        return checkpointed(df)

    def finish(self, df: DataFrame) -> DataFrame:
        """The result as a checkpoint, with all intermediate tables deleted."""
        out = self.keep(df)
        self.clear()
        return out


def weight(df: DataFrame) -> tuple[int, int]:
    """(rows, about the bytes they take in memory) of a table, in one pass."""
    size = F.lit(0).cast("long")
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind in ("string", "binary"):
            size = size + 16 + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind in ("array", "map", "struct"):
            size = size + 32 + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        else:
            size = size + 16
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return row["n"], row["bytes"]


def bounded(df: DataFrame, most: int = BROADCAST) -> DataFrame:
    """A written table with a broadcast hint, if its rows were measured to take at most so many bytes; beyond, Spark
    shuffles."""
    return F.broadcast(df) if weight(df)[1] <= most else df


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Arrow batches of few bytes from here on in this session, as rows hold whole texts: by default 10,000 rows or
    64 MB go to Python at once. The results don't depend on it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"[^0-9]", "", spark.conf.get(key))) > most:
        spark.conf.set(key, str(most))


def aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns of names that nothing else has, and these names by the old ones; whatever extra columns are
    called, no step of an operator meets them by name. toDF(*docs.columns) gives the old names back."""
    names = [f"__c{k}" for k in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names, strict=True))


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges(a, b) -> (node, root), root the smallest node of the component; nodes without edges don't appear.

    Every round hooks each node to its smallest neighbour, jumps pointers once and contracts the graph,
    so rounds grow with the logarithm of a component's diameter. Aggregates are partial before the
    shuffle, joins are equi-joins that adaptive execution can split, nothing is collected.
    """
    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    e = scratch.cut(edges.where("a <> b").select(*pair("a", "b")).distinct(), "edges", True)
    steps: list[DataFrame] = []
    while not e.isEmpty():
        both = e.union(e.select("b", "a"))
        up = both.groupBy(F.col("a").alias("v")).agg(F.least("v", F.min("b")).alias("p"))
        over = up.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        jump = scratch.cut(up.join(over, "p", "left").select("v", F.coalesce("pp", "p").alias("p")), "jump", True)
        steps.append(jump)
        e = e.join(jump.toDF("a", "pa"), "a").join(jump.toDF("b", "pb"), "b").where("pa <> pb").select(*pair("pa", "pb"))
        e = scratch.cut(e.distinct(), "edges", True)
    if not steps:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    labels = steps[0].toDF("node", "root")
    for jump in steps[1:]:
        labels = labels.join(jump.toDF("root", "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
    return scratch.cut(labels, "labels", True)
