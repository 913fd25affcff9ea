"""Boosted trees and forests as tables of leaf paths: margins of every prefix of an ensemble, and exact
path-wise Shapley attributions (EXP-1).

A saved model's nodes are read into arrays (bounded by trees x nodes) that travel with the tasks; tasks then
work on whole batches of rows.  ``margins`` lets all rows descend a tree side by side.  ``contributions``
never walks a tree per row: every leaf is a path of merged conditions, one per feature, and a row's share of
the leaf depends only on which of the path's conditions it meets, so each leaf has one small table of shares
by pattern, and rows look their pattern up.

The value of a feature set is the path-dependent expectation: conditions on features of the set are tested,
all others count with the share of training rows that met them.  Base value + contributions = raw score.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_path

#: Paths of up to this many features keep a table of all their patterns.
TABLE_FEATURES = 8


@dataclass
class Path:
    """A leaf: its value, and per feature the half-open interval (low, high] and the share of training rows
    inside it, product over the path's splits of that feature."""

    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


class Ensemble:
    """Trees of a saved model: per tree feature, threshold, children, weighted leaf value and row count."""

    def __init__(self, trees: list[dict]):
        self.trees = trees
        self._paths: list[Path] | None = None
        self._tables: dict[int, np.ndarray] = {}

    @classmethod
    def load(cls, spark, folder: str) -> Ensemble:
        """From the folder of a saved GBT or random forest classification or regression model."""
        weights = {r[0]: r[2] for r in spark.read.parquet(f"{folder}/treesMetadata").collect()}     # one row per tree
        is_forest = "RandomForestClassification" in spark.read.text(f"{folder}/metadata").first()[0]
        rows = spark.read.parquet(f"{folder}/data").select("treeID", "nodeData.*").collect()         # trees x nodes
        by_tree: dict[int, list] = {}
        for r in rows:
            by_tree.setdefault(r["treeID"], []).append(r)
        trees = []
        for t in sorted(by_tree):
            nodes = sorted(by_tree[t], key=lambda r: r["id"])
            if any(r["split"]["numCategories"] >= 0 for r in nodes if r["leftChild"] >= 0):
                raise ValueError("categorical splits are not supported")
            if is_forest:   # share of class 1 in the leaf, averaged over the trees
                value = [r["impurityStats"][1] / sum(r["impurityStats"]) / len(by_tree) for r in nodes]
            else:
                value = [r["prediction"] * weights[t] for r in nodes]
            trees.append({"feature": np.array([r["split"]["featureIndex"] for r in nodes]),
                          "threshold": np.array([r["split"]["leftCategoriesOrThreshold"][0] if r["leftChild"] >= 0 else 0.0
                                                 for r in nodes]),
                          "left": np.array([r["leftChild"] for r in nodes]), "right": np.array([r["rightChild"] for r in nodes]),
                          "value": np.array(value), "rows": np.array([r["rawCount"] for r in nodes], np.float64)})
        return cls(trees)

    @classmethod
    def of(cls, model, spark) -> Ensemble:
        """From a fitted model, through its saved form in the shared folder."""
        folder = shared_path(spark, "ensemble")
        model.write().save(folder)
        return cls.load(spark, folder)

    def margins(self, x: np.ndarray, prefixes: list[int]) -> np.ndarray:
        """Raw scores (rows x prefixes) of the first ``prefixes`` trees."""
        total, out = np.zeros(len(x)), np.zeros((len(x), len(prefixes)))
        for t, tree in enumerate(self.trees):
            at = np.zeros(len(x), np.int64)
            rows = np.flatnonzero(tree["left"][at] >= 0)
            while len(rows):
                node = at[rows]
                goes_left = x[rows, tree["feature"][node]] <= tree["threshold"][node]
                at[rows] = np.where(goes_left, tree["left"][node], tree["right"][node])
                rows = rows[tree["left"][at[rows]] >= 0]
            total += tree["value"][at]
            for j, size in enumerate(prefixes):
                if size == t + 1:
                    out[:, j] = total
        return out

    def paths(self) -> list[Path]:
        if self._paths is None:
            self._paths = [p for tree in self.trees for p in _leaf_paths(tree)]
        return self._paths

    def base(self) -> float:
        return float(sum(p.value * p.share.prod() for p in self.paths()))

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """Shapley values (rows x features) of the raw score."""
        out = np.zeros(x.shape)
        for number, p in enumerate(self.paths()):
            m = len(p.features)
            if not m:
                continue
            values = x[:, p.features]
            met = (values > p.low) & (values <= p.high)
            pattern = met @ (1 << np.arange(m))
            if m <= TABLE_FEATURES:
                if number not in self._tables:
                    self._tables[number] = shares(p, np.arange(1 << m)[:, None] >> np.arange(m) & 1)
                table, row = self._tables[number], pattern
            else:
                known, row = np.unique(pattern, return_inverse=True)
                table = shares(p, known[:, None] >> np.arange(m) & 1)
            out[:, p.features] += table[row]
        return out


def _leaf_paths(tree: dict) -> list[Path]:
    out, stack = [], [(0, {})]
    while stack:
        node, known = stack.pop()
        left, right = tree["left"][node], tree["right"][node]
        if left < 0:
            names = sorted(known)
            low, high, share = (np.array([known[f][i] for f in names]) for i in range(3))
            out.append(Path(float(tree["value"][node]), np.array(names, np.int64), low, high, share))
            continue
        f, cut = int(tree["feature"][node]), float(tree["threshold"][node])
        low, high, share = known.get(f, (-np.inf, np.inf, 1.0))
        for child, bounds in ((left, (low, min(high, cut))), (right, (max(low, cut), high))):
            part = tree["rows"][child] / tree["rows"][node]
            stack.append((int(child), {**known, f: (*bounds, share * part)}))
    return out


def shares(path: Path, met: np.ndarray) -> np.ndarray:
    """Contributions (patterns x features) of one leaf for rows that meet some of its conditions.

    A feature i adds value * (met_i - share_i) * sum over s of s! (m - 1 - s)! / m! times the coefficient of
    t^s in the product over the other features j of (met_j t + share_j).
    """
    m = len(path.features)
    weight = np.array([factorial(s) * factorial(m - 1 - s) / factorial(m) for s in range(m)])
    out = np.zeros((len(met), m))
    for i in range(m):
        poly = np.zeros((len(met), m))
        poly[:, 0] = 1.0
        for j in range(m):
            if j != i:
                shifted = np.zeros_like(poly)
                shifted[:, 1:] = poly[:, :-1] * met[:, j, None]
                poly = poly * path.share[j] + shifted
        out[:, i] = path.value * (met[:, i] - path.share[i]) * (poly @ weight)
    return out


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(batch.num_columns - 1)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _mapped(frame: DataFrame, keep: list[str], fn, out: str) -> DataFrame:
    """``keep`` columns of the frame and the array column ``out`` = fn(feature matrix), batch by batch."""
    schema = T.StructType([*[frame.schema[c] for c in keep], T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                made = fn(_rows(batch))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * made.shape[1]),
                                                 pa.array(made.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*keep, out])

    return frame.select(*keep, vector_to_array("features").alias("_x")).mapInArrow(run, schema)


def prefix_margins(frame: DataFrame, ensemble: Ensemble, prefixes: list[int], keep: list[str]) -> DataFrame:
    """Columns ``keep`` and ``margins``: raw scores of the first prefixes of trees."""
    return _mapped(frame, keep, lambda x: ensemble.margins(x, prefixes), "margins")


def attributions(frame: DataFrame, ensemble: Ensemble, features: list[str], keep: list[str]) -> DataFrame:
    """EXP-1 for trees: columns ``keep``, base_value, c_<feature> of every feature, and raw_score, their sum
    with the base value."""
    size, base = len(ensemble.trees), ensemble.base()

    def both(x):
        return np.concatenate([ensemble.contributions(x), ensemble.margins(x, [size])], axis=1)

    found = _mapped(frame, keep, both, "_c")
    return found.select(*keep, F.lit(base).alias("base_value"),
                        *[F.col("_c")[i].alias(f"c_{f}") for i, f in enumerate(features)],
                        F.col("_c")[len(features)].alias("raw_score"))
