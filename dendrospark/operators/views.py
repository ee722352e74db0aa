"""Views of a neuron: directions, extents, cameras, quality, sampling of poses."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import lot
from .topology import branches, topology

GOLDEN = math.pi * (3 - math.sqrt(5))


def even_places(i, n: int):
    """Height and angle of the i-th of n directions that lie evenly on the sphere."""
    return 1 - (2 * i + 1) / n, i * GOLDEN


def fibonacci_sphere(spark: SparkSession, n: int, jitter: float = 0.0, seed: int = 0) -> DataFrame:
    """(i, dx, dy, dz): n directions spread evenly over the sphere; ``jitter`` shifts angles by up to so much and heights by an n-th of it."""
    z, angle = even_places(F.col("id"), n)
    if jitter:
        u = lambda k: 2 * uniform(F.col("id"), seed, k) - 1
        z, angle = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z + u(1) * jitter / n)), angle + u(0) * jitter
    r = F.sqrt(F.greatest(F.lit(0.0), 1 - z * z))
    return spark.range(n).select(F.col("id").alias("i"), (r * F.cos(angle)).alias("dx"), (r * F.sin(angle)).alias("dy"), z.alias("dz"))


def uniform(key: Column, seed: int, k: int) -> Column:
    """A number between 0 and 1 by hash."""
    return (F.pmod(F.xxhash64(key, F.lit(seed), F.lit(k)), F.lit(2**31)) + 0.5) / 2**31


def random_sphere(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """n directions drawn evenly; each depends on its number and the seed only."""
    z, a = 2 * uniform(F.col("id"), seed, 0) - 1, 2 * math.pi * uniform(F.col("id"), seed, 1)
    r = F.sqrt(1 - z * z)
    return spark.range(n).select(F.col("id").alias("i"), (r * F.cos(a)).alias("dx"), (r * F.sin(a)).alias("dy"), z.alias("dz"))


def covariance(nodes: DataFrame) -> DataFrame:
    """Per neuron the six entries of the covariance of its positions (n - 1) and the count."""
    pairs = [(a, b) for k, a in enumerate("xyz") for b in "xyz"[k:]]
    return nodes.groupBy("neuron_id").agg(*[F.covar_samp(a, b).alias(f"c{a}{b}") for a, b in pairs], F.count("*").alias("n"))


def principal_axes(nodes: DataFrame) -> DataFrame:
    """(neuron_id, values, axes, ratio): eigenvalues in falling order, axes with their largest component positive, and the first value by the third."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            m = np.nan_to_num(p[["cxx", "cxy", "cxz", "cxy", "cyy", "cyz", "cxz", "cyz", "czz"]].to_numpy(float)).reshape(-1, 3, 3)
            w, v = np.linalg.eigh(m)
            w, v = w[:, ::-1], np.swapaxes(v[:, :, ::-1], 1, 2)
            lead = np.take_along_axis(v, np.abs(v).argmax(axis=2)[:, :, None], axis=2)
            v = v * np.where(lead < 0, -1.0, 1.0)
            yield pd.DataFrame({"neuron_id": p["neuron_id"], "values": list(w), "axes": [list(map(list, a)) for a in v], "ratio": w[:, 0] / np.maximum(w[:, 2], 1e-12)})

    cov = covariance(nodes)
    kind = cov.schema["neuron_id"].dataType.simpleString()
    return cov.mapInPandas(run, f"neuron_id {kind}, values array<double>, axes array<array<double>>, ratio double")


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def plane(d: list[Column]) -> tuple[list[Column], list[Column]]:
    """Two axes of the image plane seen along unit direction ``d``; the helper axis is Y, or Z where ``d`` nearly is Y."""
    steep = F.abs(d[1]) > 0.95
    helper = [F.lit(0.0), F.when(steep, 0.0).otherwise(1.0), F.when(steep, 1.0).otherwise(0.0)]
    u = unit(cross(d, helper))
    return u, unit(cross(u, d))


def unit(v: list[Column]) -> list[Column]:
    size = F.sqrt(sum(x * x for x in v)) + 1e-12
    return [x / size for x in v]


MOST_DIRECTIONS = 10_000


def projected_extents(nodes: DataFrame, directions: DataFrame) -> DataFrame:
    """(neuron_id, i, width, height, diagonal) of each neuron's box seen along each direction. Directions are a short stated list (checked) and are broadcast."""
    if directions.count() > MOST_DIRECTIONS:
        raise ValueError(f"more than {MOST_DIRECTIONS} directions")
    u, v = plane(unit([F.col(c) for c in ("dx", "dy", "dz")]))
    d = directions.select("i", *[c.alias(f"u{k}") for k, c in enumerate(u)], *[c.alias(f"v{k}") for k, c in enumerate(v)])
    on = lambda p: sum(F.col(f"{p}{k}") * F.col(a) for k, a in enumerate("xyz"))
    # Dealt by neuron before the rows are multiplied: the grouping then needs no second shuffle.
    rows = nodes.select("neuron_id", "x", "y", "z").repartition("neuron_id").crossJoin(F.broadcast(d))
    box = rows.groupBy("neuron_id", "i").agg((F.max(on("u")) - F.min(on("u"))).alias("width"), (F.max(on("v")) - F.min(on("v"))).alias("height"))
    return box.withColumn("diagonal", F.sqrt(F.col("width") ** 2 + F.col("height") ** 2))


def guided_directions(nodes: DataFrame, n_canonical: int = 6, n_biased: int = 12, n_random: int = 6, seed: int = 0) -> DataFrame:
    """(neuron_id, i, tier, direction): both ways along the axes, then the most sidelong of an even pool, then random ones by hash.

    Sidelong means little along the third axis. Those within 15 degrees of a
    canonical direction, either way, are taken only if there are too few others.
    Neurons of under ten nodes, or nearly round ones (first eigenvalue under 1.1
    times a positive third), get an even spread instead (tier fibonacci). All
    neurons of a batch are chosen for at once.
    """
    total = n_canonical + n_biased + n_random

    def even(n: int) -> np.ndarray:
        z, a = even_places(np.arange(n), n)
        r = np.sqrt(np.maximum(0, 1 - z * z))
        return np.stack([r * np.cos(a), r * np.sin(a), z], 1)

    pool, spread = even(max(4 * n_biased, 48)), even(total)

    def chosen(axes: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Directions of many neurons and which of them there are."""
        m = len(axes)
        canonical = np.stack([axes, -axes], 2).reshape(m, 6, 3)[:, : min(n_canonical, 6)]
        order = np.argsort(np.abs(axes[:, 2] @ pool.T), axis=1, kind="stable")
        dots = np.abs(canonical @ pool.T).max(axis=1, initial=0.0)
        same = np.isclose(pool[None, :, None], canonical[:, None]).all(axis=3).any(axis=2)
        late = np.where(dots <= math.cos(math.radians(15)), 0, np.where(same, 2, 1))
        late = np.take_along_axis(late, order, axis=1)
        first = np.argsort(late, axis=1, kind="stable")[:, :n_biased]
        biased, there = pool[np.take_along_axis(order, first, axis=1)], np.take_along_axis(late, first, axis=1) < 2
        u = np.stack([_noise(key[:, None] + k * 2**20 + np.arange(n_random)[None]) for k in range(2)])
        z, a = 2 * u[0] - 1, 2 * math.pi * u[1]
        random = np.stack([np.sqrt(1 - z * z) * np.cos(a), np.sqrt(1 - z * z) * np.sin(a), z], 2)
        return np.concatenate([canonical, biased, random], axis=1), np.concatenate([np.ones(canonical.shape[:2], bool), there, np.ones((m, n_random), bool)], axis=1)

    tiers = np.array(["canonical"] * min(n_canonical, 6) + ["biased"] * min(n_biased, len(pool)) + ["random"] * n_random)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            values, axes = (np.array([list(map(list, a)) if c == "axes" else list(a) for a in p[c]], float).reshape(len(p), 3, -1) for c in ("values", "axes"))
            flat = (p["n"].to_numpy() < 10) | ((values[:, 2, 0] > 0) & (p["ratio"].to_numpy() < 1.1))
            d, there = chosen(axes[~flat], p["key"].to_numpy()[~flat])
            who, place = np.nonzero(there)
            guided = pd.DataFrame({"neuron_id": p["neuron_id"].to_numpy()[~flat][who], "i": np.cumsum(there, axis=1)[who, place] - 1, "tier": tiers[place], "direction": list(d[who, place])})
            who, place = np.repeat(np.flatnonzero(flat), total), np.tile(np.arange(total), int(flat.sum()))
            yield pd.concat([guided, pd.DataFrame({"neuron_id": p["neuron_id"].to_numpy()[who], "i": place, "tier": "fibonacci", "direction": list(spread[place])})])

    counts = nodes.groupBy("neuron_id").agg(F.count("*").alias("n"))
    rows = principal_axes(nodes).join(counts, "neuron_id").select("neuron_id", "n", "ratio", "values", "axes", F.xxhash64("neuron_id", F.lit(seed)).alias("key"))
    return rows.mapInPandas(run, f"neuron_id {rows.schema['neuron_id'].dataType.simpleString()}, i int, tier string, direction array<double>")


def _noise(x: np.ndarray) -> np.ndarray:
    """Numbers between 0 and 1 from whole numbers, by mixing their bits."""
    h = x.astype(np.int64).view(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return ((h >> np.uint64(12)).astype(float) + 0.5) / 2**52


def look_at(eye: np.ndarray, target: np.ndarray, up: np.ndarray) -> np.ndarray:
    f = (target - eye) / np.linalg.norm(target - eye)
    r = np.cross(f, up)
    r /= np.linalg.norm(r)
    out = np.eye(4)
    out[:3, :3] = [r, np.cross(r, f), -f]
    out[:3, 3] = -out[:3, :3] @ eye
    return out


def perspective(fovy: float, aspect: float, near: float, far: float) -> np.ndarray:
    t = 1 / math.tan(math.radians(fovy) / 2)
    return np.array([[t / aspect, 0, 0, 0], [0, t, 0, 0], [0, 0, (far + near) / (near - far), 2 * far * near / (near - far)], [0, 0, -1, 0]])


def orthographic(half: float, aspect: float, near: float, far: float) -> np.ndarray:
    return np.array([[1 / (half * aspect), 0, 0, 0], [0, 1 / half, 0, 0], [0, 0, -2 / (far - near), -(far + near) / (far - near)], [0, 0, 0, 1]])


def is_perspective(projection: str) -> bool:
    """Both spellings in use are accepted."""
    return projection in ("perspective", "persp")


# Of a box in halves of its size from its centre: the corners, the middles of the faces, and the centre twice.
BOX_POINTS = [*product((-1, 1), repeat=3), *[tuple(side * (k == j) for j in range(3)) for k in range(3) for side in (-1, 1)], (0, 0, 0), (0, 0, 0)]


def boxes(nodes: DataFrame) -> DataFrame:
    """(neuron_id, c0..c2, h0..h2): centre and half size of each neuron's box."""
    lo, hi = ([f(a) for a in "xyz"] for f in (F.min, F.max))
    return nodes.groupBy("neuron_id").agg(*[((a + b) / 2).alias(f"c{k}") for k, (a, b) in enumerate(zip(lo, hi, strict=True))], *[((b - a) / 2).alias(f"h{k}") for k, (a, b) in enumerate(zip(lo, hi, strict=True))])


def framing(nodes: DataFrame, margin: float = 0.85, fovy: float = 45.0) -> DataFrame:
    """(neuron_id, target, ortho_scale, ortho_distance, distance): how a camera along Z takes in each neuron, without and with perspective."""
    radius = F.greatest(F.lit(1e-6), F.sqrt(sum(F.col(f"h{k}") ** 2 for k in range(3))))
    far = margin * radius / math.tan(math.radians(fovy) / 2)
    return boxes(nodes).select("neuron_id", F.array("c0", "c1", "c2").alias("target"), (margin * radius).alias("ortho_scale"), (3 * radius + 1).alias("ortho_distance"), far.alias("distance"))


def qc_fractions(nodes: DataFrame, view_projection: np.ndarray) -> DataFrame:
    """(neuron_id, fraction): the share of sixteen points of each neuron's box that lie in the clip volume."""

    def inside(place: tuple[int, int, int]) -> Column:
        p = [*[F.col(f"c{k}") + s * F.col(f"h{k}") for k, s in enumerate(place)], F.lit(1.0)]
        x, y, z, w = (sum(F.lit(float(v)) * q for v, q in zip(row, p, strict=True)) for row in view_projection)
        size = F.greatest(F.lit(1e-6), w)
        return F.when(F.greatest(*[F.abs(v / size) for v in (x, y, z)]) <= 1, 1).otherwise(0)

    return boxes(nodes).select("neuron_id", (sum(map(inside, BOX_POINTS)) / len(BOX_POINTS)).alias("fraction"))


def first_passing(candidates: DataFrame, key: str, order: str, score: str, least: float) -> DataFrame:
    """Per key the first candidate whose score is enough, else the best one."""
    ok = F.when(F.col(score) >= least, F.struct(F.lit(0), F.col(order).cast("double"))).otherwise(F.struct(F.lit(1), -F.col(score).cast("double")))
    rest = [c for c in candidates.columns if c != key]
    return candidates.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(ok, order)).alias("v")).select(key, "v.*")


def sample_poses(views: DataFrame, n: int, group: str = "neuron_id", order: str = "view_id", how: str = "random", seed: int = 0) -> DataFrame:
    """``n`` views per neuron without replacement, by hash; or the first; or all."""
    if how == "all":
        return views
    key = lot(F.col(group), F.col(order), F.lit(seed)) if how == "random" else F.col(order)
    w = Window.partitionBy(group).orderBy(key, order)
    return views.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= (n if how == "random" else 1)).drop("__r")


def scaled_radii(nodes: DataFrame, radius_scale: float = 1.0, alpha: float = 0.0, percentile: float = 50.0) -> DataFrame:
    """Nodes with scaled_radius, the radius times ``radius_scale``; with ``alpha`` above 0 thin neurites are scaled more than thick ones.

    The scale is then 1 + (radius_scale - 1) w / (1 + w), w = (ref / radius)^alpha cut
    to 0..10. ``ref`` is a percentile over the radii of all branches from the soma
    on, in which a branch's start counts once for each child. What no branch
    reaches, and the soma, keep their radius.
    """
    t = topology(nodes)
    below = t.where("has_parent and soma_hops > 0 and soma_hops = depth - soma_depth")
    start = t.select("neuron_id", F.col("idx").alias("parent"), ((F.col("n_children") > 1) | (F.col("idx") == F.col("soma_idx"))).alias("starts"))
    radii = below.join(start, ["neuron_id", "parent"]).select("neuron_id", F.explode(F.array_compact(F.array("radius", F.when(F.col("starts"), F.col("pradius"))))).alias("r"))
    ref = radii.groupBy("neuron_id").agg(F.percentile("r", F.lit(min(100.0, max(0.0, percentile)) / 100)).alias("__ref"))
    w = F.least(F.lit(10.0), F.greatest(F.lit(0.0), F.pow(F.col("__ref") / (F.col("radius") + 1e-12), F.lit(float(alpha)))))
    scale = F.when((F.lit(alpha) > 0) & (F.col("__ref") > 0), 1 + (radius_scale - 1) * w / (1 + w)).otherwise(F.lit(float(radius_scale)))
    reached = below.select("neuron_id", "idx", F.lit(True).alias("__in"))
    rows = nodes.join(ref, "neuron_id", "left").join(reached, ["neuron_id", "idx"], "left")
    return rows.withColumn("scaled_radius", F.when(F.col("__in"), F.col("radius") * scale).otherwise(F.col("radius"))).drop("__ref", "__in")


def tubes(nodes: DataFrame, segments: int = 32, radius: str = "radius") -> DataFrame:
    """(neuron_id, first, at, k, vertex, x, y, z): rings of ``segments`` points around the nodes of every branch, across the way from the node before to the one after.

    ``vertex`` numbers a branch's points from 0, ring by ring; ``tube_faces`` uses it.
    """
    if segments < 3:
        raise ValueError("a ring needs three points")
    along = branches(nodes).select("neuron_id", "first", F.posexplode("nodes").alias("at", "idx"))
    rows = along.join(nodes.select("neuron_id", "idx", "x", "y", "z", F.col(radius).alias("r")), ["neuron_id", "idx"])
    w = Window.partitionBy("neuron_id", "first").orderBy("at")
    way = unit([F.coalesce(F.lead(a).over(w), F.col(a)) - F.coalesce(F.lag(a).over(w), F.col(a)) for a in "xyz"])
    rows = rows.select("*", *[c.alias(f"d{k}") for k, c in enumerate(way)])
    u, v = plane([F.col(f"d{k}") for k in range(3)])
    rows = rows.select("*", *[c.alias(f"u{k}") for k, c in enumerate(u)], *[c.alias(f"v{k}") for k, c in enumerate(v)], F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("k"))
    angle = F.col("k") * (2 * math.pi / segments)
    ring = [(F.col(a) + F.col("r") * (F.cos(angle) * F.col(f"u{k}") + F.sin(angle) * F.col(f"v{k}"))).alias(a) for k, a in enumerate("xyz")]
    return rows.select("neuron_id", "first", "at", "k", (F.col("at") * segments + F.col("k")).alias("vertex"), *ring)


def tube_faces(nodes: DataFrame, segments: int = 32) -> DataFrame:
    """(neuron_id, first, a, b, c): two triangles for each side between neighbouring rings, by vertex number."""
    gaps = branches(nodes).select("neuron_id", "first", F.explode(F.sequence(F.lit(0), (F.size("nodes") - 1) * segments - 1)).alias("a"))
    k = F.col("a") % segments
    right = F.col("a") - k + (k + 1) % segments
    pair = F.array(F.struct("a", (F.col("a") + segments).alias("b"), (right + segments).alias("c")), F.struct("a", (right + segments).alias("b"), right.alias("c")))
    return gaps.select("neuron_id", "first", F.explode(pair).alias("f")).select("neuron_id", "first", "f.*")
