"""Tube meshes of neurons: rings along the branches from the soma on, caps, the soma's sphere, faces on one vertex list a neuron, PLY and OBJ texts.

One shuffle by neuron; all branches of a batch of whole trees are swept at once.
A ring stands across the mean of the unit ways to it and from it. Its axes come
from the spherical angles of that direction, or (``frames="transported"``) from
the first ring's axes by the smallest rotations from ring to ring. Those compose
along a branch, so all of them follow from pairwise products by doubling the
distance, for every branch at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .topology import NODE, of_trees, tree_numbers, whole_trees
from .views import scaled_radii

MERGED = 1e-8  # a branch whose ends are nearer than this is closed and gets no caps
ZERO = 1e-13
TREES = 4_000  # nodes whose trees are swept together, at least
RINGS = 20_000  # rings written together
TEXT_BYTES = 4_000_000  # texts passed on together
CLASSES = pa.array(["OTHER", "SOMA", "AXON", "BASAL_DENDRITE", "APICAL_DENDRITE"])
FOUR, LEFT = (np.frombuffer(b"".join(str(i).encode().rjust(4, fill) for i in range(10_000)), np.uint32) for fill in (b"0", b"\0"))  # four digits
EXACT = 4e7  # numbers below it keep eight decimals in a double's integers
BALLS = 128  # neurons whose spheres are written together
SPHERES = 1_000  # texts of a sphere's faces that a task remembers


def unit(v: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(v, axis=-1, keepdims=True)
    return np.divide(v, size, out=v.copy(), where=size > ZERO)


@cache
def icosphere(times: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Points on the unit sphere and triangles: an icosahedron whose faces are cut in four ``times`` times."""
    golden = (1 + 5**0.5) / 2
    points = [p for a in (-1, 1) for b in (-golden, golden) for p in ((0, a, b), (a, b, 0), (b, 0, a))]
    v = unit(np.array(points, float))
    near = np.linalg.norm(v[:, None] - v[None], axis=2) < 1.1
    faces = np.array([(i, j, k) for i in range(12) for j in range(i + 1, 12) for k in range(j + 1, 12) if near[i, j] and near[j, k] and near[i, k]])
    inward = (np.cross(v[faces[:, 1]] - v[faces[:, 0]], v[faces[:, 2]] - v[faces[:, 0]]) * v[faces[:, 0]]).sum(axis=1) < 0
    faces[inward] = faces[inward][:, ::-1]
    for _ in range(times):
        sides = np.sort(np.stack([faces, np.roll(faces, -1, axis=1)], 2).reshape(-1, 2), axis=1)
        middle, of = np.unique(sides, axis=0, return_inverse=True)
        m = of.reshape(-1, 3) + len(v)
        v = unit(np.r_[v, v[middle].mean(axis=1)])
        faces = np.r_[np.c_[faces[:, 0], m[:, 0], m[:, 2]], np.c_[faces[:, 1], m[:, 1], m[:, 0]], np.c_[faces[:, 2], m[:, 2], m[:, 1]], m]
    return v, faces


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of quaternions (w, x, y, z)."""
    w = a[:, :1] * b[:, :1] - (a[:, 1:] * b[:, 1:]).sum(axis=1, keepdims=True)
    return np.c_[w, a[:, :1] * b[:, 1:] + b[:, :1] * a[:, 1:] + np.cross(a[:, 1:], b[:, 1:])]


def turned(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    t = 2 * np.cross(q[:, 1:], v)
    return v + q[:, :1] * t + np.cross(q[:, 1:], t)


def spherical_axes(normal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two axes across each direction, from its angles; for no direction those across Z."""
    known = np.linalg.norm(normal, axis=1) > ZERO
    theta = np.where(known, np.arctan2(normal[:, 1], normal[:, 0]), 0.0)
    phi = np.where(known, np.arccos(np.clip(normal[:, 2], -1, 1)), 0.0)
    x = np.c_[np.sin(theta), -np.cos(theta), np.zeros(len(theta))]
    return x, np.c_[np.cos(phi) * np.cos(theta), np.cos(phi) * np.sin(theta), -np.sin(phi)]


def transported_axes(normal: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Axes that turn from ring to ring no more than the direction does; ``at`` counts each branch's rings from 0. A ring without direction keeps that before."""
    known = np.linalg.norm(normal, axis=1) > ZERO
    last = np.maximum.accumulate(np.where(known | (at == 0), np.arange(len(at)), 0))
    normal = np.where(known[last][:, None], normal[last], [0.0, 0.0, 1.0])
    before = np.roll(normal, 1, axis=0)
    dot = (before * normal).sum(axis=1)
    x, _ = spherical_axes(before)
    # Half a turn has no axis of its own: any across the direction will do.
    q = unit(np.where((dot > -1 + 1e-12)[:, None], np.c_[1 + dot, np.cross(before, normal)], np.c_[np.zeros(len(at)), x]))
    q[at == 0] = (1, 0, 0, 0)
    step = 1
    while step <= at.max(initial=0):
        more = np.flatnonzero(at >= step)
        q[more] = times(q[more], q[more - step])
        step *= 2
    start = np.arange(len(at)) - at
    return tuple(turned(q, a[start]) for a in spherical_axes(normal))


def digits(n: np.ndarray, fill: np.ndarray = LEFT) -> np.ndarray:
    """Whole numbers below 10 ** 16 as rows of bytes, with zero bytes on the left."""
    if n.max(initial=0) < 10_000:
        return fill[n].view(np.uint8).reshape(len(n), 4)
    high, low = np.divmod(n, 10_000)
    mine = FOUR[low] if fill is FOUR else np.where(high > 0, FOUR[low], LEFT[low])
    above = digits(high, fill)
    above[high == 0] = 0
    return np.concatenate([above, mine.view(np.uint8).reshape(len(n), 4)], 1)


def decimals(x: np.ndarray) -> np.ndarray:
    """Numbers with eight decimals as rows of bytes, zero bytes among them: the text that Python's format gives."""

    def exact(v: np.ndarray, width: int = 0) -> np.ndarray:
        said = [f"{i:.8f}".encode() for i in v.tolist()]
        width = width or max(map(len, said))
        return np.frombuffer(b"".join(t.rjust(width, b"\0") for t in said), np.uint8).reshape(len(said), width)

    size = np.abs(x)
    if not (size < EXACT).all():
        return exact(x)
    scaled = size * 1e8
    whole, part = np.divmod(np.rint(scaled).astype(np.int64), 10**8)
    a, b = (FOUR[v].view(np.uint8).reshape(len(x), 4) for v in np.divmod(part, 10_000))
    out = np.concatenate([np.where(np.signbit(x), 45, 0).astype(np.uint8)[:, None], digits(whole), np.full((len(x), 1), 46, np.uint8), a, b], 1)
    # The product is rounded, so numbers halfway between two texts are left to the format.
    doubt = np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) <= np.spacing(scaled))
    if len(doubt):
        out[doubt] = exact(x[doubt], out.shape[1])
    return out


def text_rows(mark: bytes, columns: list[np.ndarray]) -> np.ndarray:
    """Lines of texts as rows of bytes; zero bytes are no part of a text."""
    parts = [np.broadcast_to(np.frombuffer(mark, np.uint8), (len(columns[0]), len(mark)))]
    for c in columns:
        parts += [np.full((len(c), 1), 32, np.uint8), c]
    return np.concatenate([*parts, np.full((len(columns[0]), 1), 10, np.uint8)], 1)


def text_of(rows: np.ndarray) -> bytes:
    return rows.tobytes().translate(None, b"\0")


class Sweep:
    """Branches of many trees as rings: of each ring its tree, branch, place, point, radius and axes; of each tree where its parts lie in the vertex list."""

    def __init__(self, t: pa.Table, at: dict[str, int], radius: str, segments: int, cap: bool, frames: str, centred: bool):
        get = lambda c: t.column(at[c]).to_numpy()
        tree, idx, kind, parent = tree_numbers(t.column(at["neuron_id"])), get("idx"), get("type_id"), get("parent")
        xyz, size = np.stack([get(c).astype(float) for c in "xyz"], 1), get(radius).astype(float)
        out = of_trees(tree, idx, kind, xyz, get("radius").astype(float), parent)
        me = np.arange(len(idx))
        key = tree.astype(np.int64) * 2**32 + (idx.astype(np.int64) + 2**31)
        order = np.argsort(key, kind="stable")
        up = me.copy()
        has = out["has_parent"]
        up[has] = order[np.searchsorted(key[order], tree[has].astype(np.int64) * 2**32 + (parent[has].astype(np.int64) + 2**31))]
        is_soma = idx == out["soma_idx"]
        below = (out["soma_hops"] > 0) & (out["soma_hops"] == out["depth"] - out["soma_depth"])
        starts = below & (is_soma[up] | (out["n_children"][up] != 1))
        # Nodes of a branch in order: below-soma nodes by the start they come from, found by doubling.
        anc, hops = np.where(below & ~starts, up, me), (below & ~starts).astype(np.int64)
        while (anc[anc] != anc).any():
            hops += hops[anc]
            anc = anc[anc]
        inner = np.flatnonzero(below)
        inner = inner[np.lexsort((hops[inner], anc[inner]))]
        first = np.flatnonzero(starts)
        rank = np.searchsorted(first, anc[inner])
        place = np.arange(len(inner)) + rank + 1
        n = len(inner) + len(first)
        self.node, self.branch = np.empty(n, np.int64), np.empty(n, np.int64)
        self.node[place], self.branch[place] = inner, rank
        head = place[hops[inner] == 0] - 1
        self.node[head], self.branch[head] = up[first], np.arange(len(first))
        self.start = head
        self.rings = np.diff(np.r_[head, n])
        self.at = np.arange(n) - head[self.branch] if n else np.zeros(0, np.int64)
        self.first = idx[first].astype(np.int64)
        self.tree = tree[first]
        trees = int(tree[-1]) + 1
        somas = np.flatnonzero(is_soma)
        origin, self.soma_radius = np.zeros((trees, 3)), np.zeros(trees)
        origin[tree[somas]] = xyz[somas]
        self.soma_radius[tree[somas]] = get("radius").astype(float)[somas]
        self.ids = t.column(at["neuron_id"]).combine_chunks().take(pa.array(np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]])))
        self.centre = np.zeros_like(origin) if centred else origin
        self.point = xyz[self.node] - (origin[self.tree][self.branch] if centred else 0.0)
        self.radius = size[self.node]
        last = self.start + self.rings - 1
        way = unit(np.r_[self.point[1:], self.point[-1:]] - self.point) if n else self.point
        from_ = np.roll(way, 1, axis=0)
        normal = unit(way + from_)
        normal[self.start], normal[last] = way[self.start], from_[last]
        self.axes = spherical_axes(normal) if frames == "spherical" else transported_axes(normal, self.at)
        self.open = np.linalg.norm(self.point[self.start] - self.point[last], axis=1) >= MERGED
        self.segments, self.capped = segments, self.open & cap
        # Class: that of the node a branch starts at, or of its second node where it starts at the soma.
        named = np.where(kind[up[first]] == 1, first, up[first])
        self.kind = np.where((kind[named] >= 1) & (kind[named] <= 4), kind[named], 0)
        count = self.rings * segments + 2 * self.capped
        total = np.bincount(self.tree, count, trees).astype(np.int64)
        before = np.r_[0, np.cumsum(count)][:-1] if len(count) else np.zeros(0, np.int64)
        tree_from = np.r_[0, np.cumsum(total)][:-1]
        self.offset = before - tree_from[self.tree]
        self.sphere_offset = total

    def vertices(self, sphere: bool = True) -> Iterator[dict[str, np.ndarray]]:
        """Vertices with tree, vertex number, branch (index of its first node; -1 for the soma), class, ring, place in it (-1: centre of a cap)."""
        angle = np.arange(self.segments) * (2 * np.pi / self.segments)
        for a in range(0, len(self.at), RINGS):
            s = slice(a, a + RINGS)
            x, y = (v[s][:, None, :] for v in self.axes)
            p = self.point[s][:, None, :] + self.radius[s][:, None, None] * (np.cos(angle)[None, :, None] * x + np.sin(angle)[None, :, None] * y)
            b, at = (np.repeat(v[s], self.segments) for v in (self.branch, self.at))
            k = np.tile(np.arange(self.segments), len(p))
            yield self.told(self.tree[b], self.offset[b] + at * self.segments + k, self.first[b], self.kind[b], at, k, p.reshape(-1, 3))
        b = np.repeat(np.flatnonzero(self.capped), 2)
        end = np.tile([0, 1], len(b) // 2)
        at = np.where(end, self.rings[b] - 1, 0)
        yield self.told(self.tree[b], self.offset[b] + self.rings[b] * self.segments + end, self.first[b], self.kind[b], at, np.full(len(b), -1), self.point[self.start[b] + at])
        if not sphere:
            return
        t = np.flatnonzero(self.soma_radius > 0)
        ball, _ = icosphere()
        n = len(ball)
        p = self.centre[t][:, None] + self.soma_radius[t][:, None, None] * ball[None]
        tree, k = np.repeat(t, n), np.tile(np.arange(n), len(t))
        yield self.told(tree, self.sphere_offset[tree] + k, np.full(len(tree), -1), np.ones(len(tree), np.int64), np.zeros(len(tree), np.int64), k, p.reshape(-1, 3))

    def told(self, tree, vertex, branch, kind, at, k, p) -> dict[str, np.ndarray]:
        return {"tree": tree, "vertex": vertex, "branch": branch, "class": kind, "at": at, "k": k, "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]}

    def faces(self, sphere: bool = True) -> Iterator[dict[str, np.ndarray]]:
        """Triangles: two for each side between neighbouring rings, fans on the caps, the sphere."""
        m = self.segments
        k = np.arange(m)
        next_ = (k + 1) % m
        gap = np.flatnonzero(self.at < self.rings[self.branch] - 1)
        for i in range(0, len(gap), RINGS):
            g = gap[i : i + RINGS]
            b = self.branch[g]
            low = (self.offset[b] + self.at[g] * m)[:, None]
            a, c, up, cup = (low + v[None] for v in (k, next_, k + m, next_ + m))
            corners = np.stack([np.stack([a, c, up], 2), np.stack([cup, up, c], 2)], 2).reshape(-1, 3)
            yield self.faced(np.repeat(self.tree[b], 2 * m), np.repeat(self.kind[b], 2 * m), corners)
        b = np.flatnonzero(self.capped)
        low, high = self.offset[b][:, None], (self.offset[b] + (self.rings[b] - 1) * m)[:, None]
        centre = (self.offset[b] + self.rings[b] * m)[:, None] + np.zeros((1, m), np.int64)
        fans = np.concatenate([np.stack([centre, low + next_, low + k], 2), np.stack([high + k, high + next_, centre + 1], 2)], 1).reshape(-1, 3)
        yield self.faced(np.repeat(self.tree[b], 2 * m), np.repeat(self.kind[b], 2 * m), fans)
        if not sphere:
            return
        t = np.flatnonzero(self.soma_radius > 0)
        _, triangles_ = icosphere()
        tree = np.repeat(t, len(triangles_))
        yield self.faced(tree, np.ones(len(tree), np.int64), (self.sphere_offset[t][:, None, None] + triangles_[None]).reshape(-1, 3))

    def faced(self, tree, kind, corners) -> dict[str, np.ndarray]:
        return {"tree": tree, "class": kind, "a": corners[:, 0], "b": corners[:, 1], "c": corners[:, 2]}


def swept(nodes: DataFrame, schema: str, rows: Callable[[Sweep], Iterator[dict]], segments: int, cap: bool, frames: str, centred: bool, radius: str) -> DataFrame:
    """Rows that ``rows`` makes of the sweeps of whole trees; ``tree`` becomes neuron_id."""
    if segments < 3:
        raise ValueError("a ring needs three points")
    if frames not in ("spherical", "transported"):
        raise ValueError(f"unknown frames: {frames}")
    order = "line_no" if "line_no" in nodes.columns else "idx"
    names = [*NODE, *([radius] if radius not in NODE else [])]
    kind = nodes.schema["neuron_id"].dataType.simpleString()
    fields = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_trees(batches, 0, TREES):
            sweep = Sweep(t, {c: i for i, c in enumerate(names)}, radius, segments, cap, frames, centred)
            for found in rows(sweep):
                ids = sweep.ids.take(pa.array(found["tree"]))
                yield pa.RecordBatch.from_arrays([ids, *(CLASSES.take(pa.array(found[f])) if f == "class" else pa.array(found[f]) for f in fields)], names=["neuron_id", *fields])

    rows_of = nodes.select(*[F.col(c).cast("int").alias(c) if c in ("idx", "type_id", "parent") else F.col(c) for c in names], *([order] if order not in names else []))
    return rows_of.repartition("neuron_id").sortWithinPartitions("neuron_id", order).select(*names).mapInArrow(run, f"neuron_id {kind}, {schema}")


def mesh_vertices(nodes: DataFrame, segments: int = 32, cap: bool = False, frames: str = "spherical", centred: bool = True, radius: str = "radius", sphere: bool = True) -> DataFrame:
    """(neuron_id, vertex, branch, class, at, k, x, y, z): all points of each neuron's mesh, numbered from 0.

    ``branch`` is the first node of a branch after its start, -1 for the soma's
    sphere; ``at`` the ring; ``k`` the place in it, -1 for the centre of a cap. The
    soma lies at the origin if ``centred``. ``radius`` names the column that the rings
    take; the sphere takes ``radius``. What isn't below the soma has no mesh; a
    soma without a positive radius has no sphere; coincident nodes give rings
    across Z. Nodes must be unique (``unique_nodes``). ``sphere=False`` leaves out the
    soma's points, which come last.
    """
    return swept(nodes, "vertex bigint, branch bigint, class string, at bigint, k bigint, x double, y double, z double", lambda sweep: sweep.vertices(sphere), segments, cap, frames, centred, radius)


def mesh_faces(nodes: DataFrame, segments: int = 32, cap: bool = False, sphere: bool = True) -> DataFrame:
    """(neuron_id, class, a, b, c): the triangles, by the numbers of ``mesh_vertices``, seen from outside counter-clockwise on caps and sphere (which ``sphere=False`` leaves out)."""
    return swept(nodes, "class string, a bigint, b bigint, c bigint", lambda sweep: sweep.faces(sphere), segments, cap, "spherical", True, "radius")


def neuron_mesh(nodes: DataFrame, segments: int = 32, cap: bool = False, radius_scale: float = 1.0, alpha: float = 0.0, percentile: float = 50.0, **how) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces with radii scaled by ``scaled_radii``; the soma's isn't."""
    scaled = scaled_radii(nodes, radius_scale, alpha, percentile)
    return mesh_vertices(scaled, segments, cap, radius="scaled_radius", **how), mesh_faces(nodes, segments, cap)


def triangles(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(neuron_id, class, corners): every face with its three points, as a renderer's buffers take them."""
    points = vertices.select("neuron_id", F.col("vertex").alias("v"), F.array("x", "y", "z").alias("p"))
    corners = faces.withColumn("face", F.monotonically_increasing_id()).select("neuron_id", "class", "face", F.posexplode(F.array("a", "b", "c")).alias("corner", "v"))
    return corners.join(points, ["neuron_id", "v"]).groupBy("neuron_id", "class", "face").agg(F.sort_array(F.collect_list(F.struct("corner", "p"))).alias("c")).select("neuron_id", "class", F.flatten("c.p").alias("corners"))


def mesh_texts(nodes: DataFrame, kind: str = "ply", segments: int = 32, cap: bool = False, frames: str = "spherical", centred: bool = True, radius: str = "radius") -> DataFrame:
    """(neuron_id, name, content): each neuron's mesh as a text file, PLY or OBJ; ``write_files`` writes them. Neurons without a mesh have no row."""
    if kind not in ("ply", "obj"):
        raise ValueError(f"unknown kind of mesh: {kind}")

    first, mark = (0, b"3") if kind == "ply" else (1, b"f")
    sphere, corners = icosphere()
    spheres: dict[int, bytes] = {}

    def points(p: np.ndarray) -> np.ndarray:
        rows = text_rows(b"" if kind == "ply" else b"v", [decimals(c) for c in p.T])
        return rows[:, 1:] if kind == "ply" else rows

    def sphere_faces(offset: int) -> bytes:
        if offset not in spheres:
            if len(spheres) >= SPHERES:
                spheres.clear()
            spheres[offset] = text_of(text_rows(mark, [digits(c) for c in (corners + offset + first).T]))
        return spheres[offset]

    def texts(sweep: Sweep) -> Iterator[dict]:
        tubes, faces = ({k: np.concatenate([p[k] for p in found]) for k in names} for found, names in ((list(sweep.vertices(False)), ("tree", "vertex", "x", "y", "z")), (list(sweep.faces(False)), ("tree", "a", "b", "c"))))
        order = np.lexsort((tubes["vertex"], tubes["tree"]))
        tube_rows = points(np.stack([tubes[k][order] for k in "xyz"], 1))
        order_f = np.argsort(faces["tree"], kind="stable")
        face_rows = text_rows(mark, [digits(faces[k][order_f] + first) for k in "abc"])
        trees = np.arange(len(sweep.ids) + 1)
        v, f = np.searchsorted(tubes["tree"][order], trees).tolist(), np.searchsorted(faces["tree"][order_f], trees).tolist()
        made, held, balls = ([], []), 0, None
        for t in range(len(sweep.ids)):
            soma = sweep.soma_radius[t] > 0
            if t % BALLS == 0:
                near = slice(t, t + BALLS)
                balls = points((sweep.centre[near, None] + sweep.soma_radius[near, None, None] * sphere).reshape(-1, 3))
                balls = balls.reshape(-1, len(sphere), balls.shape[1])
            (a, b), (c, d) = v[t : t + 2], f[t : t + 2]
            if a == b and not soma:
                continue
            head = b""
            if kind == "ply":
                n, m = b - a + len(sphere) * soma, d - c + len(corners) * soma
                head = f"ply\nformat ascii 1.0\nelement vertex {n}\nproperty float x\nproperty float y\nproperty float z\nelement face {m}\nproperty list uchar int vertex_indices\nend_header\n".encode()
            ball = text_of(balls[t % BALLS]) if soma else b""
            content = b"".join((head, text_of(tube_rows[a:b]), ball, text_of(face_rows[c:d]), sphere_faces(b - a) if soma else b""))
            made[0].append(t)
            made[1].append(content)
            held += len(content)
            if held >= TEXT_BYTES:
                yield {"tree": np.array(made[0]), "content": made[1]}
                made, held = ([], []), 0
        if made[0]:
            yield {"tree": np.array(made[0]), "content": made[1]}

    made = swept(nodes, "content binary", texts, segments, cap, frames, centred, radius)
    return made.select("neuron_id", F.concat(F.col("neuron_id").cast("string"), F.lit(f".{kind}")).alias("name"), "content")


def read_obj(texts: DataFrame) -> DataFrame:
    """(neuron_id, vertices, faces, last): what OBJ texts of lines "v" and "f" (neuron_id, content) hold; ``last`` is the greatest vertex that a face names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = []
            for content in batch.column(1):
                text = b"\n" + content.as_py()
                named = np.fromstring(re.sub(rb"\nv [^\n]*", b"", text).replace(b"\nf ", b" "), np.int64, sep=" ")
                found.append((text.count(b"\nv "), text.count(b"\nf "), named.max() if len(named) else None))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int32(), pa.int32(), pa.int64()), strict=True))], names=["neuron_id", "vertices", "faces", "last"])

    kind = texts.schema["neuron_id"].dataType.simpleString()
    return texts.select("neuron_id", "content").mapInArrow(run, f"neuron_id {kind}, vertices int, faces int, last bigint")
