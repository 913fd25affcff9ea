"""Grid search for boosted trees with shared prefixes (ML-6, ML-7).

A boosted ensemble of n rounds is the first n trees of any longer one with the same other parameters and
seed, so points that differ in the number of rounds alone need one fit: 81 points are 27 fits a fold, 216
are 72.  Every prefix of a fit is scored on the held-out fold in one pass over its rows, and the exact AUCs
of all points and folds come from one rank job.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product
from math import ceil
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import hashing as H
from ..functions.ranking import auc_from_scores, rank_within
from ..session import growing, passing, shared_path, stored
from .trees import Ensemble, prefix_margins

ROUNDS = "maxIter"
#: Training rows of a task: the bagged copies that a fit keeps are some hundred bytes a row, for every tree.
TASK_ROWS = 100_000


def balanced_folds(frame: DataFrame, folds: int, key: str = S.ID_COL, label: str = "label") -> DataFrame:
    """Adds ``held_out``: 0 to folds - 1, each with equally many rows of either class (one more at most), dealt
    in hash order within the class.  Only key, hash and label go through the rank job."""
    ranked = rank_within(frame.select(key, label).withColumn("_h", H.hash_hex8(key)), [label], ["_h", key], out="_r")
    sides = ranked.select(F.col(key).alias("_key"), ((F.col("_r") - 1) % folds).cast("int").alias("held_out"))
    return growing(frame).join(sides, F.col(key) == F.col("_key")).drop("_key")


def dealt(train: DataFrame) -> DataFrame:
    """Training rows in tasks of about ``TASK_ROWS`` rows, in a fixed order; a table of one task stays as it is."""
    tasks = ceil(train.count() / TASK_ROWS)
    if tasks < 2:
        return train
    return train.repartition(tasks).sortWithinPartitions(train.columns[0])


def abreast(spark, rows: int, most: int) -> int:
    """Fits to run side by side: enough for three tasks a core, ``most`` at most.  Each keeps all its binned rows."""
    tasks = max(1, ceil(rows / TASK_ROWS))
    return max(1, min(most, ceil(3 * spark.sparkContext.defaultParallelism / tasks)))


def points(grid: dict) -> list[dict]:
    """All points of a grid, the last parameter fastest."""
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def _group(point: dict) -> tuple:
    return tuple((k, v) for k, v in point.items() if k != ROUNDS)


def search(frame: DataFrame, estimator, grid: dict, folds: int = 3, key: str = S.ID_COL, parallelism: int = 4,
           prepare: Callable[[DataFrame], DataFrame] | None = None) -> list[tuple[dict, float, list[float]]]:
    """(point, mean AUC, AUC of each fold) of every point of ``grid``, in grid order.

    ``prepare`` is applied to the training rows of each fold (for instance to oversample them), never to held-out
    rows.  A fold's training rows are made, fitted and let go; folds run side by side as far as fits do
    (``abreast``, ``parallelism`` at most).  A fold without both classes has no AUC and is left out of the mean.
    """
    every = points(grid)
    groups = list(dict.fromkeys(map(_group, every)))
    rounds = sorted({p.get(ROUNDS, estimator.getOrDefault(ROUNDS)) for p in every})
    spark = frame.sparkSession
    rows = stored(balanced_folds(frame, folds, key), "search-rows")
    folder = shared_path(spark, "search-scores")
    fits = abreast(spark, rows.count(), parallelism)
    side_by_side = min(folds, fits)

    def fit(job: tuple[int, int, DataFrame]) -> None:
        g, k, train = job
        params = {estimator.getParam(n): v for n, v in groups[g]} | {estimator.getParam(ROUNDS): rounds[-1]}
        model = estimator.copy(params).fit(train)
        scored = prefix_margins(rows.where(F.col("held_out") == k), Ensemble.of(model, spark), rounds, ["label"])
        scored.write.parquet(f"{folder}/point={g}/fold={k}")

    def fold(k: int) -> None:
        part = rows.where(F.col("held_out") != k)
        with passing(spark):
            train = dealt(prepare(part) if prepare else part).persist()
            try:
                with ThreadPool(max(1, min(len(groups), fits // side_by_side))) as pool:
                    pool.map(fit, [(g, k, train) for g in range(len(groups))], 1)
            finally:
                train.unpersist()

    with ThreadPool(side_by_side) as pool:
        pool.map(fold, range(folds), 1)
    scores = spark.read.parquet(folder).select(
        "point", "fold", "label", F.posexplode("margins").alias("prefix", "margin"))
    measured = auc_from_scores(scores, "label", "margin", by=("point", "prefix", "fold")).collect()  # points x folds
    auc = {(r["point"], rounds[r["prefix"]], r["fold"]): r["auc"] for r in measured}
    out = []
    for p in every:
        g, n = groups.index(_group(p)), p.get(ROUNDS, rounds[-1])
        per = [auc[g, n, k] for k in range(folds) if auc.get((g, n, k)) is not None]
        out.append((p, sum(per) / len(per) if per else float("nan"), per))
    return out


def best_point(found: list[tuple[dict, float, list[float]]]) -> dict:
    """The point of greatest mean AUC, the first of equals."""
    best = max((mean for _, mean, _ in found if mean == mean), default=None)
    return next((p for p, mean, _ in found if mean == best), found[0][0])
