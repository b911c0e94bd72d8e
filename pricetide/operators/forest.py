"""Quantile regression forest on Spark ML trees.

Every tree cuts the inputs into leaves; a training row weighs 1 / (rows of the
leaf) in each tree in which it shares the asked row's leaf, averaged over the
trees.  The asked quantile is the weighted order statistic of the training
targets under these weights.  Leaves are never gathered: targets fall into the
cells of a grid with about equal shares, cells are counted per (tree, leaf),
and an asked row adds up its leaves' cumulative shares.  What is kept is
trees × leaves × cells numbers, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import PandasUDFType

from pricetide.session import durable


@dataclass
class QuantileForest:
    """``edges``: ends of the cells; leaf_shares[tree][leaf][cell] = part of the leaf's rows up to the cell's end."""

    forest: RandomForestRegressionModel
    edges: list[float]
    leaf_shares: list[list[list[float]]]

    def transform(self, df: DataFrame, levels: Mapping[str, float], prefix: str = "_q_") -> DataFrame:
        """One column per level.  Levels never cross: all are read off the same rising curve.

        Rows are scored in Arrow batches against one copy of the shares a worker; a row carries its leaf numbers only.
        """
        edges, top = np.array(self.edges), max(len(tree) for tree in self.leaf_shares)
        cells, trees = len(edges) - 1, len(self.leaf_shares)
        shares = np.zeros((trees, top, cells))
        for k, tree in enumerate(self.leaf_shares):
            shares[k, : len(tree)] = tree
        asked = list(levels.values())

        def read_off(leaves):
            import pandas as pd

            parts = []
            for start in range(0, len(leaves), 2000):
                leaf = np.stack(leaves.iloc[start : start + 2000]).astype(np.int64)
                curve = np.zeros((len(leaf), cells))
                for k in range(trees):
                    curve += shares[k][leaf[:, k]]
                curve /= trees
                at, found = np.arange(len(leaf)), []
                for q in asked:
                    reached = curve >= q - 1e-9
                    cell = np.where(reached.any(1), reached.argmax(1), cells - 1)
                    below = np.where(cell > 0, curve[at, cell - 1], 0.0)
                    step = curve[at, cell] - below
                    part = np.clip(np.divide(q - below, step, out=np.zeros(len(leaf)), where=step != 0), 0.0, 1.0)
                    found.append(edges[cell] + part * (edges[cell + 1] - edges[cell]))
                parts.extend(np.stack(found, 1).tolist())
            return pd.Series(parts, dtype=object)

        quantiles = F.pandas_udf(read_off, "array<double>", PandasUDFType.SCALAR)
        rows = self.forest.transform(df).withColumn("_found", quantiles(vector_to_array("_leaf"))).drop("_leaf", "_f")
        return rows.withColumns({f"{prefix}{name}": F.col("_found")[i] for i, name in enumerate(levels)}).drop("_found")


def _grid(rows: DataFrame, cells: int) -> list[float]:
    """Distinct ends of cells with about equal shares of the targets."""
    ends = rows.agg(F.min("_y").alias("low"), F.max("_y").alias("high")).first()
    inner = rows.approxQuantile("_y", [k / cells for k in range(1, cells)], 1 / (8 * cells))
    edges = sorted({float(e) for e in (ends["low"], *inner, ends["high"])})
    return edges if len(edges) > 1 else [edges[0], edges[0] + 1e-12]


def fit(rows: DataFrame, trees: int = 120, depth: int = 5, min_rows: int = 100, cells: int = 128, seed: int = 20261008) -> QuantileForest:
    """Rows of inputs ``_x`` and target ``_y``."""
    rows = durable(rows.where(F.col("_y").isNotNull()))
    forest = RandomForestRegressor(
        featuresCol="_x", labelCol="_y", predictionCol="_f", leafCol="_leaf", numTrees=trees, maxDepth=depth, minInstancesPerNode=min_rows,
        featureSubsetStrategy="onethird", seed=seed,
    ).fit(rows)
    edges = _grid(rows, cells)
    n = len(edges) - 1
    placed = Bucketizer(splits=[-float("inf"), *edges[1:-1], float("inf")], inputCol="_y", outputCol="_cell") if n > 1 else None
    rows = placed.transform(rows) if placed else rows.withColumn("_cell", F.lit(0.0))
    hits = forest.transform(rows).select(F.col("_cell").cast("int").alias("cell"), F.posexplode(vector_to_array("_leaf")).alias("tree", "leaf"))
    counted = hits.groupBy("tree", F.col("leaf").cast("int").alias("leaf"), "cell").agg(F.count("*").alias("n"))
    # At most `cells` entries a leaf, 2^depth leaves a tree.
    leaf = counted.groupBy("tree", "leaf").agg(F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("_n"), F.sum("n").alias("_all"))
    upto = F.aggregate(
        F.sequence(F.lit(0), F.lit(n - 1)),
        F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<double>").alias("shares")),
        lambda s, c: F.struct((s["sum"] + F.coalesce(F.col("_n")[c], F.lit(0))).alias("sum"), F.concat(s["shares"], F.array((s["sum"] + F.coalesce(F.col("_n")[c], F.lit(0))) / F.col("_all"))).alias("shares")),
        lambda s: s["shares"],
    )
    tree = leaf.select("tree", "leaf", upto.alias("shares")).groupBy("tree").agg(F.map_from_entries(F.collect_list(F.struct("leaf", "shares"))).alias("_l"), F.max("leaf").alias("_top"))
    # Leaves are numbered from 0; a number without training rows shares nothing.
    none = F.array_repeat(F.lit(0.0), n)
    tree = tree.select("tree", F.transform(F.sequence(F.lit(0), F.col("_top")), lambda k: F.coalesce(F.col("_l")[k], none)).alias("leaves"))
    # Model parameters: trees × leaves × cells numbers, whatever the number of rows.
    return QuantileForest(forest, edges, [r["leaves"] for r in tree.orderBy("tree").collect()])
