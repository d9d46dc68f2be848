"""Places of nodes in space."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgraph.operators import repulsion
from loamgraph.operators.graph import neighbour_lists, pieces
from loamgraph.operators.ranking import with_position
from loamgraph.plans.shared import materialize

# Colours of nodes' kinds and edges' relations.
EDGE_COLOURS = {"sibling": "#d4a84b", "contains": "#22d3ee", "next": "#67e8f9", "relates_to": "#a78bfa", "mentions": "#f472b6", "same_as": "#f8fafc", "conflicts_with": "#fbbf24"}
OTHER_COLOUR = "#8a938c"
# Fixed values of the forces: repulsion, spring, length, length a spread, damping, most speed, radius of the ball.
REPULSION, SPRING, LENGTH, LENGTH_SPREAD, DAMPING, MOST_SPEED, BALL = 420, 0.035, 26, 7, 0.82, 22, 480
#: Rows and columns of a tile of pairs of nodes whose forces are summed at a time (half a MB an array).
TILE = 256
#: Up to this many nodes one task does all rounds.
ONE_TASK = 8_192
#: Springs whose pull a task works out at a time.
SPRINGS_AT_ONCE = 1 << 18
GOLDEN = math.pi * (1 + math.sqrt(5))


def on_sphere(i: Column, n: Column, radius: Column) -> tuple[Column, Column, Column]:
    """The i-th of n evenly spread points of a sphere."""
    phi = F.acos(1 - 2 * (i + 0.5) / F.greatest(n, F.lit(1)))
    theta = F.lit(GOLDEN) * i
    return radius * F.sin(phi) * F.cos(theta), radius * F.cos(phi), radius * F.sin(phi) * F.sin(theta)


def place_files(nodes: DataFrame) -> DataFrame:
    """(id, x, y, z) of file nodes in order of their id; the radius is 90 + 4 * min(n, 40)."""
    n = nodes.count()
    placed = with_position(nodes.select("id"), ["id"])
    x, y, z = on_sphere(F.col("position"), F.lit(max(n, 1)), F.lit(90.0 + 4 * min(max(n, 1), 40)))
    return placed.select("id", x.alias("x"), y.alias("y"), z.alias("z"))


def layout_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree): all edges at each node; a loop counts twice."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def place_entities(nodes: DataFrame, edges: DataFrame, spread: float = 1.0) -> DataFrame:
    """(id, degree, radius, x, y, z): the farther out, the more edges a node has."""
    k = min(15.0, max(1.0, spread))
    n = nodes.count()
    placed = with_position(layout_degrees(nodes, edges), ["id"])
    radius = F.least(F.lit(420.0), 32 + F.log2(F.col("degree") + 1) * k * 11)
    x, y, z = on_sphere(F.col("position"), F.lit(max(n, 1)), radius)
    return placed.select("id", "degree", radius.alias("radius"), x.alias("x"), y.alias("y"), z.alias("z"))


def place_chunks(chunks: DataFrame, files: DataFrame, spread: float = 1.0) -> DataFrame:
    """(id, x, y, z) of chunk nodes around their file, which must be placed."""
    k = min(15.0, max(1.0, spread))
    inside = Window.partitionBy("path")
    rows = chunks.select("path", "chunk_index").distinct().withColumn("i", F.row_number().over(inside.orderBy("chunk_index")) - 1).withColumn("n", F.count(F.lit(1)).over(inside))
    radius = F.greatest(F.lit(13.0), (16 + 0.5 * F.least(F.col("n"), F.lit(40))) * (k / 4))
    x, y, z = on_sphere(F.col("i"), F.col("n"), radius)
    hubs = files.select(F.col("id").alias("path"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("z").alias("_z"))
    return rows.join(hubs, "path").select(F.concat_ws("#", "path", "chunk_index").alias("id"), (F.col("_x") + x).alias("x"), (F.col("_y") + y).alias("y"), (F.col("_z") + z).alias("z"))


def pushes(at: np.ndarray, weight: np.ndarray, k: float) -> np.ndarray:
    """The repulsion between all nodes, summed for each.

    Each pair is met once. Its strength is a sum of products of what each node has, so a tile of pairs gives both sums by
    matrix products."""
    held, square = np.column_stack([np.ones(len(at)), weight, at, at * weight[:, None]]), (at**2).sum(axis=1)
    left, right = np.column_stack([at, square, np.ones(len(at))]), np.column_stack([-2 * at, np.ones(len(at)), square + 1]).T.copy()
    sums = np.zeros((len(at), 8))
    for i in range(0, len(at), TILE):
        for j in range(i, len(at), TILE):
            near = left[i : i + TILE] @ right[:, j : j + TILE]
            near *= np.sqrt(near)
            np.divide(1.0, near, out=near)
            if i == j:
                np.fill_diagonal(near, 0.0)
            sums[i : i + TILE] += near @ held[j : j + TILE]
            if i != j:
                sums[j : j + TILE] += near.T @ held[i : i + TILE]
    own = 1 + k * weight
    return REPULSION * (at * (own * sums[:, 0] + k * sums[:, 1])[:, None] - own[:, None] * sums[:, 2:5] - k * sums[:, 5:8])


def pulls(at: np.ndarray, springs: np.ndarray, k: float) -> np.ndarray:
    """What the springs (row, row) do to the nodes."""
    along = at[springs[:, 1]] - at[springs[:, 0]]
    length = np.linalg.norm(along, axis=1) + 0.1
    pull = along / length[:, None] * (SPRING * (length - (LENGTH + k * LENGTH_SPREAD)))[:, None]
    of = lambda ends: np.column_stack([np.bincount(ends, pull[:, x], len(at)) for x in range(3)])
    return of(springs[:, 0]) - of(springs[:, 1])


def cooled(at: np.ndarray, force_at: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Positions after some rounds of these forces; everything cools, is damped, and stays in a ball."""
    at, speed = at.copy(), np.zeros((len(at), 3))
    rounds = min(48, 16 + math.ceil(len(at) / 8))
    for r in range(rounds if len(at) > 1 else 0):
        speed += (1 - r / rounds) * force_at(at)
        speed *= DAMPING
        speed *= np.minimum(1, MOST_SPEED / np.maximum(np.linalg.norm(speed, axis=1), 1e-12))[:, None]
        at += speed
        at *= np.minimum(1, BALL / np.maximum(np.linalg.norm(at, axis=1), 1e-12))[:, None]
    return at


def relax(start: pd.DataFrame, springs: np.ndarray, spread: float = 1.0) -> np.ndarray:
    """Positions after pushing all nodes apart and pulling linked ones together for a while.

    Repulsion falls with the square of the distance and grows with the logarithm of both degrees; springs have a rest
    length."""
    k = min(15.0, max(1.0, spread))
    weight = np.log2(start["degree"].to_numpy(float) + 1)
    return cooled(start[["x", "y", "z"]].to_numpy(float), lambda at: pushes(at, weight, k) + pulls(at, springs, k))


def drawn(at: np.ndarray, heads: np.ndarray, begin: np.ndarray, k: float, low: int, high: int) -> np.ndarray:
    """What the springs do to the nodes low to high; those of node v go to heads[begin[v] : begin[v + 1]]."""
    found = np.zeros((high - low, 3))
    for first, last in pieces(begin[low : high + 1], SPRINGS_AT_ONCE):
        tails = np.repeat(np.arange(first, last), np.diff(begin[low + first : low + last + 1]))
        along = at[heads[begin[low + first] : begin[low + last]]] - at[low + tails]
        length = np.linalg.norm(along, axis=1) + 0.1
        along *= (SPRING * (length - (LENGTH + k * LENGTH_SPREAD)) / length)[:, None]
        for x in range(3):
            found[first:last, x] = np.bincount(tails - first, along[:, x], last - first)
    return found


def relax_in_tasks(spark: SparkSession, start: pd.DataFrame, heads: np.ndarray, begin: np.ndarray, spread: float = 1.0) -> np.ndarray:
    """The same, with the forces on the nodes of a part of space, and of the springs of a part of the nodes, summed by one task.

    Nodes push each other by a tree of cells (``repulsion``). A round sends all positions to the tasks (24 bytes a node)
    and gets the forces back. The springs of node v go to heads[begin[v] : begin[v + 1]], both ways."""
    k, n = min(15.0, max(1.0, spread)), len(start)
    tasks = spark.sparkContext.defaultParallelism
    at_ends = np.searchsorted(begin + np.arange(n + 1), np.linspace(0, begin[-1] + n, tasks + 1))
    held = spark.sparkContext.broadcast((np.log2(start["degree"].to_numpy(float) + 1), heads, begin))

    def force_at(at: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast(at)
        level, parts = repulsion.plan(at, BALL, tasks)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (weight, heads, begin), now = held.value, sent.value
            for batch in batches:
                for u in batch.column(0).to_pylist():
                    rows, field = repulsion.fields(now, weight, BALL, level, *parts[u])
                    push = REPULSION * ((1 + k * weight[rows])[:, None] * field[:, 0] + k * field[:, 1])
                    pull = drawn(now, heads, begin, k, *at_ends[u : u + 2].tolist())
                    yield pa.RecordBatch.from_pydict({"part": pa.array([u], pa.int64()), "rows": [rows.astype(np.int32).tobytes()], "push": [push.tobytes()], "pull": [pull.tobytes()]})

        summed = np.zeros((n, 3))
        for row in spark.range(0, tasks, 1, tasks).mapInArrow(run, "part long, rows binary, push binary, pull binary").toArrow().to_pylist():
            summed[np.frombuffer(row["rows"], np.int32)] += np.frombuffer(row["push"]).reshape(-1, 3)
            summed[at_ends[row["part"]] : at_ends[row["part"] + 1]] += np.frombuffer(row["pull"]).reshape(-1, 3)
        sent.destroy()
        return summed

    return cooled(start[["x", "y", "z"]].to_numpy(float), force_at)


def linlog(nodes: DataFrame, edges: DataFrame, spread: float = 1.0, *, one_task: int = ONE_TASK) -> DataFrame:
    """(id, x, y, z) of entity nodes after the forces.

    All nodes push each other. Up to ``one_task`` nodes are one group, of which each pair is met; beyond, a tree of cells sums
    the pushes, the positions and the springs (8 bytes each) are held by the driver and a round's forces are summed by tasks."""
    spark = nodes.sparkSession
    nodes, edges = materialize(nodes.select("id"), "nodes"), materialize(edges.select("src", "dst"), "edges")
    placed = place_entities(nodes, edges, spread)
    inner = edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    if nodes.count() > one_task:
        rows = materialize(with_position(placed, ["id"]).select("position", "id", "degree", "x", "y", "z"), "placed")
        last = rows.groupBy("id").agg(F.max("position").cast("int").alias("position"))
        of = lambda end: last.select(F.col("id").alias(end), F.col("position").alias(f"at_{end}"))
        links = inner.where("src <> dst").join(of("src"), "src").join(of("dst"), "dst").select(F.col("at_src").alias("a"), F.col("at_dst").alias("b"))
        start = rows.drop("id").toArrow().sort_by("position").to_pandas()
        moved = spark.sparkContext.broadcast(relax_in_tasks(spark, start, *neighbour_lists(links, len(start)), spread))

        def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = moved.value[batch.column(1).to_numpy()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(at[:, x])) for x in range(3))], names=["id", "x", "y", "z"])

        return rows.select("id", "position").mapInArrow(put, "id string, x double, y double, z double")

    def run(_: tuple, points: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values("id").reset_index(drop=True)
        index = {x: i for i, x in enumerate(points["id"])}
        springs = np.array([(index[a], index[b]) for a, b in sorted(zip(links["src"], links["dst"], strict=True))], dtype=int).reshape(-1, 2)
        out = relax(points, springs, spread)
        return pd.DataFrame({"id": points["id"], "x": out[:, 0], "y": out[:, 1], "z": out[:, 2]})

    one = placed.select(F.lit(1).alias("g"), "id", "degree", "x", "y", "z").groupBy("g")
    return one.cogroup(inner.select(F.lit(1).alias("g"), "src", "dst").groupBy("g")).applyInPandas(run, "id string, x double, y double, z double")


def membranes(edges: DataFrame, most: int = 6) -> DataFrame:
    """(id, b, c): triangles of a node with cyclically neighbouring ones of its first ``most`` neighbours by id."""
    whole = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    near = whole.select(F.col("src").alias("id"), F.col("dst").alias("b")).unionByName(whole.select(F.col("dst").alias("id"), F.col("src").alias("b"))).distinct()
    place = near.withColumn("at", F.row_number().over(Window.partitionBy("id").orderBy("b"))).where(F.col("at") <= most)
    inside = Window.partitionBy("id")
    turned = place.withColumn("c", F.coalesce(F.lead("b").over(inside.orderBy("at")), F.min("b").over(inside))).withColumn("n", F.count(F.lit(1)).over(inside))
    return turned.where("n > 1").select("id", "b", "c")


def tube_radius(kind: Column, weight: Column) -> Column:
    """The drawn thickness of an edge: ``file`` 0.55, ``chunk`` 0.28, else growing with the weight."""
    return F.when(kind == "file", 0.55).when(kind == "chunk", 0.28).otherwise(0.12 + F.log(weight + 1) * 0.16)


def edge_colour(rel: Column) -> Column:
    """The colour an edge is drawn in by its relation."""
    chosen = F.when(F.lit(False), "")
    for name, colour in EDGE_COLOURS.items():
        chosen = chosen.when(rel == name, colour)
    return chosen.otherwise(OTHER_COLOUR)
