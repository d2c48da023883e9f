"""Helpers shared by the corpus jobs: saved tables, empty texts and connected components."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.session import ensure_checkpoint_dir

#: Word-like units of the word rules: everything between ASCII white space (fixed value).
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def saved(df: DataFrame, name: str) -> DataFrame:
    """`df` written as a table in the shared checkpoint folder and read back: lost executors cannot lose it,
    and what follows does not compute it again."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Carried:
    """A table with the columns that a job reads, and all others in one struct under numbered names: whatever they are
    called, they meet none of the job's own columns."""

    def __init__(self, docs: DataFrame, *read: str):
        self.columns, self.read = docs.columns, read
        inner = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in read]
        self.df = docs.select(*[F.col(f"`{c}`") for c in read], F.struct(F.lit(0).alias("none"), *inner).alias("carried"))

    def restored(self, leave_out: tuple[str, ...] = (), **changed) -> list:
        """The columns in their own order and names, those in `changed` with new values."""
        kept = [(i, c) for i, c in enumerate(self.columns) if c not in leave_out]
        return [(changed[c] if c in changed else F.col(c) if c in self.read else F.col(f"carried.c{i}")).alias(c) for i, c in kept]


def ascii_lower(column):
    return F.translate(column, UPPER, UPPER.lower())


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, left: str, right: str, limit: int = 60) -> DataFrame:
    """(node, component): every node named in `edges` with the smallest node reachable from it.

    Alternating large and small stars: each round hangs the neighbours of a node under its smallest neighbour,
    so hubs only meet in an aggregate and in a join that Spark can split; the rounds grow with the logarithm of
    the component size. Each round is a written table. Edges with a null end and loops are ignored; without
    edges the result is empty. Raises if `limit` rounds do not end it, rather than returning half-merged groups.
    """
    now = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
    now = saved(now.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("u") != F.col("v"))).distinct(), "edges")
    before = _signature(now)
    for _ in range(limit):
        if not before[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = saved(small.unionByName(lowest.withColumnRenamed("m", "v")).distinct(), "edges")
        after = _signature(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the edges a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label, new.copy())
        new = new[new]
        if (new == label).all():
            return label
        label = new
