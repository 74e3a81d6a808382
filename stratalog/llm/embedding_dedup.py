"""Near-duplicate embeddings by collision-counting projections.

Vectors are normalised and equal ones merged, with their number kept. In each
of ``tables`` sorted orders a vector is placed by one random projection, within
a cell that some more projections give; without cells a window of fixed width
would hold a constant share of all vectors, and the count of collisions would
grow with the square of the input. Two vectors collide where they share the
cell and lie within each other's window. Pairs that collide ``least`` times are
verified by their cosine. Cells, tables and the count are calibrated together,
so that a pair right at the threshold passes with a chance of ``recall``, and
a closer one with more.

A cell with over ``dense`` vectors is a group of near copies. It is not
counted pair by pair: it is dealt to tasks by pairs of blocks, which compare
all their vectors and return link counts and block-wise components only. Two
vectors in several common dense cells are compared in the first.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; vectors of unlike lengths link with nothing;
repeated rows (same id) count as one vector, and so do rows without an id,
which are not kept; labels and other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .components import connected_components

_CELL, _REACH = 3.0, 2.0  # cell width and window reach, in distances at the threshold


def _phi(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def calibrate(n: int, threshold: float, recall: float, least: int, crowd: float = 24.0) -> tuple[int, int, float]:
    """Projections to a cell, tables, and the chance to collide in one of them.

    A cell has so many projections that about ``crowd`` unlike vectors share a
    window, and there are so many tables that a pair at the threshold has
    ``least`` collisions with a chance of ``recall``.
    """
    r = math.sqrt(2 - 2 * threshold)
    # difference of two cells' coordinates: normal with spread r (pair at the threshold) or sqrt 2
    same = lambda s: 2 * _phi(_CELL * r / s) - 1 - 2 * s / (_CELL * r * math.sqrt(2 * math.pi)) * (1 - math.exp(-((_CELL * r / s) ** 2) / 2))
    near, far = same(r), same(math.sqrt(2))
    window = 2 * _phi(_REACH * r / math.sqrt(2)) - 1
    k = max(1, math.ceil(math.log(max(2.0, n * window / crowd)) / -math.log(far)))
    p = near**k * (2 * _phi(_REACH) - 1)
    tables = least
    while sum(math.comb(tables, i) * p**i * (1 - p) ** (tables - i) for i in range(least)) > 1 - recall:
        tables += max(1, tables // 20)
    return k, tables, p


def _unit(col: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Rows as doubles of norm 1, for vectors of one length."""
    x = np.stack(col.to_numpy()).astype(np.float64)
    return x, x / np.linalg.norm(x, axis=1, keepdims=True)


def vector_groups(table: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """All ids with their group, and one row for each distinct usable vector."""
    v = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).dropDuplicates(["id"])
    fine = (
        (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("v", lambda x: x != 0)
    )
    named = v.select("id", "v", F.coalesce(fine, F.lit(False)).alias("fine")).select(
        "id", "v", "fine", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")
    )
    named = stage(named, "vectors")
    groups = named.where("fine").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("m"), F.first("v").alias("v"))
    return named.select("id", "fine", "h1", "h2"), stage(groups.where("rep IS NOT NULL"), "groups")


def _place(groups: DataFrame, k: int, tables: int, threshold: float, seed: int) -> DataFrame:
    """``rep, t, key, at``: cell and coordinate of each vector in each table."""
    r = math.sqrt(2 - 2 * threshold)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for part in batches:
            for dim, rows in part.groupby(part["v"].map(len)):
                if dim not in known:
                    rng = np.random.default_rng([seed, int(dim)])
                    known[dim] = rng.standard_normal((int(dim), tables * (k + 1))), rng.uniform(0, 1, tables * (k + 1))
                w, shift = known[dim]
                x = (_unit(rows["v"])[1] @ w / (_CELL * r) + shift).reshape(len(rows), tables, k + 1)
                cell = np.floor(x[:, :, :k]).astype(np.int64)
                key = np.full(cell.shape[:2], dim, dtype=np.uint64) + np.arange(tables, dtype=np.uint64)[None, :] * np.uint64(1 << 32)
                for j in range(k):
                    key = (key ^ cell[:, :, j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(31)
                yield pd.DataFrame(
                    {
                        "rep": np.repeat(rows["rep"].to_numpy(), tables),
                        "t": np.tile(np.arange(tables, dtype=np.int32), len(rows)),
                        "key": key.view(np.int64).ravel(),
                        "at": x[:, :, k].ravel() * _CELL * r,
                    }
                )

    return groups.select("rep", "v").mapInPandas(run, "rep long, t int, key long, at double")


def _collisions(placed: DataFrame, reach: float) -> DataFrame:
    """``(a, b)`` for each collision, by windows over each cell's sorted coordinates."""

    def slide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail = None
        for part in batches:
            if not len(part):
                continue
            rows = part if tail is None else pd.concat([tail, part], ignore_index=True)
            old = 0 if tail is None else len(tail)
            key, at, rep = rows["key"].to_numpy(), rows["at"].to_numpy(), rows["rep"].to_numpy()
            n, step = len(rows), 1
            while step < n:
                lo = max(0, old - step)
                near = np.flatnonzero((key[lo : n - step] == key[lo + step :]) & (at[lo + step :] - at[lo : n - step] <= reach)) + lo
                if not len(near):
                    break
                a, b = rep[near], rep[near + step]
                yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})
                step += 1
            tail = rows[(key == key[-1]) & (at[-1] - at <= reach)]

    sorted_ = placed.repartition("key").sortWithinPartitions("key", "at")
    return sorted_.select("key", "at", "rep").mapInPandas(slide, "a long, b long")


def _block_components(linked: np.ndarray) -> np.ndarray:
    """Smallest index reachable, for a symmetric matrix of links."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _dense_links(members: DataFrame, groups: DataFrame, threshold: float, block: int) -> DataFrame:
    """``kind, a, b``: link counts (``n``) and component edges (``e``) of dense cells.

    ``members(rep, key, cells)``: the dense cells of each vector, in table order.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("c"))
    dealt = (
        members.join(sizes, "key")
        .withColumn("blocks", F.ceil(F.col("c") / block).cast("int"))
        .withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("rep", "key", "cells", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
        .join(groups.select("rep", "m", "v"), "rep")
    )

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rep", ignore_index=True)
        rep, m, mine = part["rep"].to_numpy(), part["m"].to_numpy(), part["mine"].to_numpy()
        key = part["key"].iloc[0]
        x, _ = _unit(part["v"])
        linked = _cosine_linked(x, threshold)
        np.fill_diagonal(linked, False)
        if part["i"].iloc[0] != part["j"].iloc[0]:
            linked &= mine[:, None] != mine[None, :]
        # cells before this one, in which a pair would have been compared already
        sooner = [set(c[: list(c).index(key)]) for c in part["cells"].map(list)]
        names = {c: n for n, c in enumerate({c for s in sooner for c in s})}
        if names:
            has = np.zeros((len(part), len(names)), dtype=np.float32)
            for row, s in enumerate(sooner):
                has[row, [names[c] for c in s]] = 1
            linked &= (has @ has.T) == 0
        count = linked @ m
        label = _block_components(linked)
        some = count > 0
        return pd.concat(
            [
                pd.DataFrame({"kind": "n", "a": rep[some], "b": count[some]}),
                pd.DataFrame({"kind": "e", "a": rep[some], "b": rep[label[some]]}),
            ],
            ignore_index=True,
        )

    return dealt.groupBy("key", "i", "j").applyInPandas(compare, "kind string, a long, b long")


def _cosine_linked(x: np.ndarray, threshold: float) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1))
    return (x @ x.T) / (norm[:, None] * norm[None, :]) >= threshold


def _verified(pairs: DataFrame, groups: DataFrame, dense: DataFrame | None, threshold: float) -> DataFrame:
    """``a, b, ma, mb`` of pairs whose cosine reaches the threshold and that no dense cell holds."""
    side = groups.select("rep", "m", "v")
    if dense is not None:
        side = side.join(dense.dropDuplicates(["rep"]).select("rep", "cells"), "rep", "left")
    else:
        side = side.withColumn("cells", F.lit(None).cast("array<bigint>"))
    full = pairs.join(side.select(F.col("rep").alias("a"), F.col("m").alias("ma"), F.col("v").alias("va"), F.col("cells").alias("ca")), "a").join(
        side.select(F.col("rep").alias("b"), F.col("m").alias("mb"), F.col("v").alias("vb"), F.col("cells").alias("cb")), "b"
    )
    full = full.where((F.size("va") == F.size("vb")) & ~F.coalesce(F.arrays_overlap("ca", "cb"), F.lit(False)))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for _, rows in part.groupby(part["va"].map(len)):
                x, y = np.stack(rows["va"].to_numpy()), np.stack(rows["vb"].to_numpy())
                cosine = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
                yield rows.loc[cosine >= threshold, ["a", "b", "ma", "mb"]]

    return full.select("a", "b", "ma", "mb", "va", "vb").mapInPandas(check, "a long, b long, ma long, mb long")


def near_duplicate_vectors(
    table: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.95,
    recall: float = 0.995,
    least: int = 2,
    dense: int = 256,
    block: int = 512,
    seed: int = 29,
) -> DataFrame:
    """``id, n_links, component_id, kept`` for every id of ``table``."""
    ids, groups = vector_groups(table, id_col, vector_col)
    k, tables, _ = calibrate(groups.count(), threshold, recall, least)
    placed = stage(_place(groups, k, tables, threshold, seed), "placed")
    cells = placed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    crowded = stage(placed.join(cells, "key"), "cells")

    reach = _REACH * math.sqrt(2 - 2 * threshold)
    counted = _collisions(crowded.where(F.col("c") <= dense), reach).groupBy("a", "b").agg(F.count("*").alias("n"))
    thick = crowded.where(F.col("c") > dense)
    thick = thick.select("rep", "t", "key")
    members = None
    if thick.limit(1).count():
        listed = thick.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("t", "key"))).alias("x"))
        members = stage(listed.select("rep", F.col("x.key").alias("cells")).select("rep", "cells", F.explode("cells").alias("key")), "dense")
    links = stage(_verified(counted.where(F.col("n") >= least).select("a", "b"), groups, members, threshold), "links")
    numbers = links.select(F.col("a").alias("rep"), F.col("mb").alias("n")).union(links.select("b", "ma"))
    edges = links.select("a", "b")
    if members is not None:
        inner = stage(_dense_links(members, groups, threshold, block), "blocks")
        numbers = numbers.union(inner.where("kind = 'n'").select("a", "b"))
        edges = edges.union(inner.where("kind = 'e'").select("b", "a"))

    labels = connected_components(edges)
    per_group = (
        groups.select("h1", "h2", "rep", "m")
        .join(numbers.groupBy("rep").agg(F.sum("n").alias("n")), "rep", "left")
        .join(labels.withColumnRenamed("node", "rep"), "rep", "left")
        .select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n"), F.coalesce("component", "rep").alias("component"), F.lit(True).alias("fine"))
    )
    return (
        ids.join(per_group, ["h1", "h2", "fine"], "left")
        .select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("component_id") == F.col("id"), F.lit(False)))
        .withColumnRenamed("id", id_col)
    )
