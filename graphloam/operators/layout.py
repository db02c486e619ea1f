"""Two-dimensional layouts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the force model.
TICKS, CHARGE, LINK, LINK_STRENGTH, COLLIDE, SPACING = 300, -260.0, 90.0, 0.35, 42.0, 12.0
GOLDEN = math.pi * (3 - math.sqrt(5))
#: Nodes of one layout; a tick holds some arrays of their square.
MOST_NODES = 5000


def spiral(ordinal: Column) -> Column:
    """struct(x, y) of a golden-angle spiral."""
    r, a = F.lit(SPACING) * F.sqrt(ordinal.cast("double")), ordinal.cast("double") * F.lit(GOLDEN)
    return F.struct((r * F.cos(a)).alias("x"), (r * F.sin(a)).alias("y"))


def grid(ordinal: Column, columns: int = 10, width: float = 220.0, height: float = 120.0) -> Column:
    """struct(x, y) of a row-wise grid."""
    return F.struct(((ordinal % columns) * F.lit(width)).cast("double").alias("x"), (F.floor(ordinal / columns) * F.lit(height)).cast("double").alias("y"))


def relax(n: int, links: list[tuple[int, int]], ticks: int = TICKS) -> np.ndarray:
    """Positions of n nodes under repulsion, springs and collision, from the spiral; the same input gives the same result.
    The work of a tick is n * n, so one repository's visible page is the unit."""
    if n > MOST_NODES:
        raise ValueError(f"{n} nodes; a page of {MOST_NODES} at most is laid out")
    i = np.arange(n)
    at = np.column_stack([SPACING * np.sqrt(i) * np.cos(i * GOLDEN), SPACING * np.sqrt(i) * np.sin(i * GOLDEN)])
    speed, alpha, decay = np.zeros((n, 2)), 1.0, 1 - 0.001 ** (1 / max(1, ticks))
    e = np.array([(a, b) for a, b in links if a != b], dtype=int).reshape(-1, 2)
    degree = np.bincount(e.ravel(), minlength=n)
    for _ in range(ticks if n > 1 else 0):
        alpha -= alpha * decay
        gap = at[:, None, :] - at[None, :, :]
        square = np.maximum((gap**2).sum(2), 1.0)
        push = (gap / square[:, :, None]).sum(1) * -CHARGE * alpha
        near = np.sqrt(square)
        overlap = np.where((near < 2 * COLLIDE) & ~np.eye(n, dtype=bool), (2 * COLLIDE - near) / near / 2, 0)
        speed += push + (gap * overlap[:, :, None]).sum(1) * 0.5
        if len(e):
            d = at[e[:, 1]] - at[e[:, 0]]
            far = np.maximum(np.sqrt((d**2).sum(1)), 1e-6)
            pull = d * ((far - LINK) / far * alpha * LINK_STRENGTH)[:, None]
            share = (degree[e[:, 0]] / (degree[e[:, 0]] + degree[e[:, 1]]))[:, None]
            np.add.at(speed, e[:, 1], -pull * share)
            np.add.at(speed, e[:, 0], pull * (1 - share))
        speed *= 0.6
        at = at + speed
        at -= at.mean(0)
    return at


def force_layout(nodes: DataFrame, edges: DataFrame, ticks: int = TICKS) -> DataFrame:
    """(repositoryId, id, x, y), a layout by force for each repository. A repository is one task's work, so the job fails where
    one has more than MOST_NODES nodes: lay out the page that is shown. Self loops and dangling edges have no effect."""
    schema = "repositoryId string, id string, x double, y double"
    every = nodes.select("repositoryId", "id").distinct()
    sizes = every.groupBy("repositoryId").agg(F.count(F.lit(1)).alias("n"))
    too_many = F.raise_error(F.concat(F.lit("repository "), "repositoryId", F.lit(f" has more than {MOST_NODES} nodes; lay out a page of them")))
    small = sizes.select("repositoryId", F.when(F.col("n") > MOST_NODES, too_many.cast("boolean")).otherwise(True).alias("small")).where("small")
    own = every.join(small, "repositoryId", "left_semi")  # fails before a task gets such a repository
    inside = edges.join(own.select(F.col("repositoryId").alias("repo"), F.col("id").alias("sourceId")), "sourceId").join(own.select(F.col("repositoryId").alias("repo"), F.col("id").alias("targetId")), ["repo", "targetId"], "left_semi").select("repo", "sourceId", "targetId")

    def run(key: tuple, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(n.id.unique())
        place = {x: i for i, x in enumerate(ids)}
        links = sorted({(place[a], place[b]) for a, b in zip(e.sourceId, e.targetId, strict=True) if a in place and b in place})
        at = relax(len(ids), links, ticks)
        return pd.DataFrame({"repositoryId": key[0], "id": ids, "x": at[:, 0], "y": at[:, 1]})

    return own.groupBy("repositoryId").cogroup(inside.groupBy("repo")).applyInPandas(run, schema)
