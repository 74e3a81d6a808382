"""Rendezvous routing: each workload goes to the node with the highest score.

The nodes of a cluster are few. Up to a checked number they travel in the
plan as an array, and each row finds its node by itself, without a join or a
shuffle. Beyond that number scores are made by a join and reduced map-side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.functions.xxh64_keys import hash_after


def score(node: Column, workload: Column) -> Column:
    """A score whose text order is that of the unsigned hash."""
    return F.md5(F.concat(node.cast("string"), F.lit(":"), workload.cast("string")))


def node_list(nodes: DataFrame, column: str, most: int) -> list[int] | None:
    """The nodes in order, or None if there are more than ``most``."""
    found = [r[0] for r in nodes.select(column).distinct().limit(most + 1).collect()]
    if not found:
        raise ValueError("there are no nodes to route to")
    return sorted(found) if len(found) <= most else None


def route(workloads: DataFrame, nodes: DataFrame, workload: str, node: str, most: int = 1000) -> DataFrame:
    """``workloads`` with the ``node_id`` of each; on a tie, the smallest id."""
    few = node_list(nodes, node, most)
    if few is not None:
        choices = F.transform(
            F.array(*[F.lit(n).cast("long") for n in few]),
            lambda n: F.struct(score(n, F.col(workload)).alias("s"), (-n).alias("n")),
        )
        return workloads.withColumn("node_id", -F.array_max(choices)["n"])
    scored = workloads.crossJoin(nodes.select(F.col(node).alias("_node")).distinct())
    best = scored.groupBy(workload).agg(
        F.max_by("_node", F.struct(score(F.col("_node"), F.col(workload)), -F.col("_node"))).alias("node_id")
    )
    return workloads.join(best, workload)


def balance(routed: DataFrame) -> DataFrame:
    """Workloads of each node."""
    return routed.groupBy("node_id").agg(F.count("*").alias("n"))


def moved(before: DataFrame, after: DataFrame, workload: str) -> DataFrame:
    """Workloads by their node before and after a change of the nodes."""
    pair = before.select(workload, F.col("node_id").alias("before_node")).join(
        after.select(workload, F.col("node_id").alias("after_node")), workload
    )
    return pair.groupBy("before_node", "after_node").agg(F.count("*").alias("n"))


def route_exact(workloads: DataFrame, nodes: list[bytes], workload: str) -> DataFrame:
    """Routing by XXH64 with seed 0 over 16 bytes of node and 16 of workload.

    ``workload`` is a column of 16 bytes; the chosen node comes as ``node_id``,
    null for a null workload. A batch is hashed for one node after the other.
    """
    if not nodes:
        raise ValueError("there are no nodes to route to")
    order = sorted(nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            keys = part.column(workload).to_pylist()
            if any(k is not None and len(k) != 16 for k in keys):
                raise ValueError("a workload must have 16 bytes")
            lanes = np.frombuffer(b"".join(bytes(16) if k is None else k for k in keys), "<u8").reshape(-1, 2)
            best, top = np.zeros(len(keys), int), hash_after(order[0], lanes)
            for i, node in enumerate(order[1:], 1):
                scores = hash_after(node, lanes)
                best[scores > top] = i
                top = np.maximum(top, scores)
            chosen = pa.array([None if k is None else order[i] for k, i in zip(keys, best)], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns, chosen], names=[*part.schema.names, "node_id"])

    fields = ", ".join(f"`{n}` {t}" for n, t in workloads.dtypes)
    return workloads.mapInArrow(run, f"{fields}, node_id binary")
