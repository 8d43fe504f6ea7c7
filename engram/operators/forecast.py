"""Forecasts of activation: dynamic mode decomposition of the snapshots of a group of nodes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.operators.graph import settled

#: Snapshots that a forecast needs, energy of the modes kept, most steps ahead, and growth that is a spike.
LEAST_STEPS, ENERGY, MOST_AHEAD, SPIKE = 10, 0.95, 10, 2.0


def modes(gram: np.ndarray, ahead: int, energy: float = ENERGY) -> tuple[np.ndarray, float, int]:
    """Weights of the snapshots for each step ahead, largest modulus of an eigenvalue, rank; gram: inner products of all snapshots.

    With X the snapshots but the last, Y those but the first and X = U S V', the inner products X'X and X'Y suffice: the map on r modes
    is S^-1 V' X'Y V S^-1, and a state c of the modes is X V S^-1 c, a weighted sum of snapshots.
    """
    square = gram[:-1, :-1]
    values, v = np.linalg.eigh(square)
    values, v = np.maximum(values[::-1], 0.0), v[:, ::-1]
    total = values.sum()
    if total <= 0:
        return np.empty((0, len(square))), 0.0, 0
    rank = min(int(np.searchsorted(np.cumsum(values) / total, energy)) + 1, int((values > 1e-12 * total).sum()))
    back = v[:, :rank] / np.sqrt(values[:rank])  # V S^-1
    step = back.T @ gram[:-1, 1:] @ back
    state, out = back.T @ gram[:-1, -1], []
    for _ in range(ahead):
        state = step @ state
        out.append(back @ state)
    return np.array(out).reshape(ahead, len(square)), float(np.abs(np.linalg.eigvals(step)).max()), rank


def koopman_forecast(series: DataFrame, *, ahead: int = 3, energy: float = ENERGY, most_steps: int = 400) -> DataFrame:
    """group, node_id, step (1, 2, ... ahead), value, max_eigenvalue, stable, rank, spike.

    series: group, node_id, step (whole numbers), value. A group's snapshots are its newest most_steps steps up to its last, however many nodes
    it has: tasks add up inner products of snapshots over their nodes (most_steps**2 numbers at most), the sums of a group are decomposed in one task, and
    each node's forecast is a weighted sum of its own values. Steps without a row, null and non-finite values are 0; rows of one node and
    step are summed; groups with fewer than ten steps, and those that are 0 throughout but for the last step, have no forecast. Rows without node or step count for nothing; a null group is one.
    """
    ahead = min(ahead, MOST_AHEAD)
    value = F.when(F.isnan("value") | F.abs("value").isin(float("inf")), 0.0).otherwise(F.coalesce(F.col("value").cast("double"), F.lit(0.0)))
    rows = series.filter("node_id is not null and step is not null").select("group", "node_id", F.col("step").cast("long").alias("step"), value.alias("value"))
    ends = rows.groupBy("group").agg(F.min("step").alias("first"), F.max("step").alias("last"))
    ends = ends.select(F.col("group").alias("g"), F.greatest("first", F.col("last") - most_steps + 1).alias("first"), "last")
    at = rows.join(ends, F.col("group").eqNullSafe(F.col("g"))).filter("step >= first and last - first + 1 >= " + str(LEAST_STEPS))
    of_step = at.groupBy("group", "node_id", (F.col("step") - F.col("first")).cast("int").alias("t"), (F.col("last") - F.col("first") + 1).cast("int").alias("n")).agg(F.sum("value").alias("value"))
    lines = settled(of_step.groupBy("group", "node_id", "n").agg(F.sort_array(F.collect_list(F.struct("t", "value"))).alias("points")))  # at most most_steps a node

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for (group, n), part in b.groupby(["group", "n"], dropna=False, sort=False):
                x = np.zeros((len(part), n))
                for row, points in zip(x, part["points"], strict=True):
                    for p in points:
                        row[p["t"]] = p["value"]
                gram = x.T @ x
                i, j = np.triu_indices(n)
                keep = gram[i, j] != 0
                yield pd.DataFrame({"group": None if pd.isna(group) else group, "n": n, "i": i[keep], "j": j[keep], "v": gram[i, j][keep]})

    kind = series.schema["group"].dataType.simpleString()
    grams = lines.mapInPandas(products, f"group {kind}, n int, i int, j int, v double").groupBy("group", "n", "i", "j").agg(F.sum("v").alias("v"))

    def decomposed(part: pd.DataFrame) -> pd.DataFrame:
        n = int(part["n"].iloc[0])
        gram = np.zeros((n, n))
        gram[part["i"], part["j"]] = gram[part["j"], part["i"]] = part["v"]
        weights, largest, rank = modes(gram, ahead, energy)
        group = part["group"].iloc[0]
        return pd.DataFrame({"g": None if pd.isna(group) else group, "step": range(1, len(weights) + 1), "weights": [list(map(float, w)) for w in weights], "max_eigenvalue": largest, "rank": rank})

    ahead_of = settled(grams.groupBy("group").applyInPandas(decomposed, f"g {kind}, step int, weights array<double>, max_eigenvalue double, rank int"))
    told = F.aggregate("points", F.lit(0.0), lambda s, p: s + p["value"] * F.coalesce(F.get("weights", p["t"]), F.lit(0.0)))  # the last snapshot has no weight
    now = F.element_at("points", -1)
    now = F.when(now["t"] == F.col("n") - 1, now["value"]).otherwise(0.0)
    out = lines.join(ahead_of, F.col("group").eqNullSafe(F.col("g"))).withColumn("value", told)
    return out.select("group", "node_id", "step", "value", "max_eigenvalue", (F.col("max_eigenvalue") <= 1.0).alias("stable"), "rank", ((now > 0) & (F.col("value") > SPIKE * now)).alias("spike"))
