"""What the operators share: tables, durable intermediate tables, words and connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.session import ship_package, stash, unstash

#: Words are runs of anything but space and U+0009 to U+000D.
WORD = "[^\\x20\\x09-\\x0D]+"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """doc_id as long and text of ``docs``; whatever else it has stays out of the way."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def n_words(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def spanning_edges(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For pairs among 0..n-1: (node, smallest node it reaches) for every node that isn't its own smallest."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (a, b) reaches, itself included.

    Alternating star contraction: every round is a distributed aggregate and an equi-join on the node, the edge list
    never grows, and rounds end when every edge points at its component's smallest node. Each round's edges are
    written to the shared folder, and those of the round before removed. No edges give no rows; null ends are dropped.
    """
    e = stash(edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        last = e
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        # every larger neighbour of u now points at the smallest node that u sees
        e = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = e.where("u <> v").distinct()
        # every smaller neighbour of u, and u itself, now points at the smallest of them
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(low.select(F.col("u").alias("k"), "m"), F.col("u") == F.col("k")).select(
            F.inline(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))))
        e = stash(e.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        unstash(last)
        # a round that changes nothing has left a forest of stars
        n, h = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, h) == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = (n, h)
