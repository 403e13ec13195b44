"""Embedding near dedup: tiled comparison in principal-axis order with suffix bounds.

Vectors are compared only where their labels (and lengths) are equal. Equal vectors
become one node first. Unit vectors are turned into the basis of their second
moments, largest first, a rotation that keeps cosines. Nodes are sorted by label and
leading coordinate and cut into tiles. Two tiles meet only if the boxes of their
leading coordinates are close enough for a cosine at the threshold. For the pairs of
two tiles products of the leading coordinates are summed first; what the rest can
add is bounded by the product of the norms of the suffixes, and pairs that cannot
reach the threshold are given up. Results near the threshold are computed again from
the vectors as given, in double precision.

A tile pair returns no pairs: per node the number of linked vectors, and links that
span the same components. So a group of thousands of copies stays a few rows.

Defined cases: null vectors, vectors without or with null or non-finite components,
zero vectors and vectors without a label link with nothing; repeated rows count as
vectors of their own; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from recordloom.llm.common import saved
from recordloom.llm.components import components

COSINE = 0.98
TILE = 1024
BOX = 8
STAGES = (8, 16, 32)
LONGEST_ROTATED = 2048
NEAR = 1e-9


def _valid(vector: str) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def principal_axes(nodes: DataFrame) -> tuple[int, np.ndarray] | None:
    """The rotation for the most frequent vector length, from the second moments of all its unit vectors.

    dim x dim numbers reach the driver, whatever the number of vectors. Vectors of
    other lengths stay as they are, which changes the speed only.
    """
    usual = nodes.filter(F.col("dim") <= LONGEST_ROTATED).groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if usual is None:
        return None
    dim = usual["dim"]

    def moments(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            unit = _unit(_rows(batch["vector"], dim))
            total += unit.T @ unit
        i, j = np.triu_indices(dim)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "s"])

    sums = nodes.filter(F.col("dim") == dim).select("vector").mapInArrow(moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    found = np.zeros((dim, dim))
    for r in sums.collect():
        found[r.i, r.j] = found[r.j, r.i] = r.s
    return dim, np.linalg.eigh(found)[1][:, ::-1].copy()


def linked_pairs(a: np.ndarray, b: np.ndarray, axes: np.ndarray | None, same: bool, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the rows of two tiles whose cosine is ``cosine`` or more; with ``same``, each pair once."""
    u, v = _unit(a), _unit(b)
    x, y = (u @ axes, v @ axes) if axes is not None else (u, v)
    dim, done, rows = x.shape[1], 0, None
    total = np.zeros((len(a), len(b)))
    if same:
        total[np.tril_indices(len(a))] = -np.inf
    for stop in [*(s for s in STAGES if s < dim), dim]:
        px, py = x[:, done:stop], y[:, done:stop]
        rest = np.sqrt((x[:, stop:] ** 2).sum(axis=1)), np.sqrt((y[:, stop:] ** 2).sum(axis=1))
        if rows is None:
            total += px @ py.T
            alive = total + np.outer(*rest) >= cosine - NEAR
            if stop == dim or alive.mean() < 0.05:
                rows, columns = np.nonzero(alive)
                sums = total[rows, columns]
        else:
            sums = sums + np.concatenate([np.einsum("ij,ij->i", px[rows[k : k + 2**16]], py[columns[k : k + 2**16]]) for k in range(0, max(1, len(rows)), 2**16)])
            alive = sums + rest[0][rows] * rest[1][columns] >= cosine - NEAR
            rows, columns, sums = rows[alive], columns[alive], sums[alive]
        done = stop
    close = np.flatnonzero(np.abs(sums - cosine) <= NEAR)
    exact = np.array([np.dot(a[i], b[j]) / (np.sqrt(np.dot(a[i], a[i])) * np.sqrt(np.dot(b[j], b[j]))) for i, j in zip(rows[close], columns[close])])
    keep = np.ones(len(rows), dtype=bool)
    keep[close] = exact >= cosine
    return rows[keep], columns[keep]


def _roots(n: int, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The smallest index that each of ``n`` points can reach over the links."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[rows], root[columns])
        new = root.copy()
        np.minimum.at(new, rows, least)
        np.minimum.at(new, columns, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _tiles(nodes: DataFrame, axes) -> DataFrame:
    """Rows of tiles: label, dim, an id, the box of the leading coordinates, node numbers, counts and vectors."""
    schema = pa.schema([("tile", pa.string()), ("label", pa.string()), ("dim", pa.int32()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("nodes", pa.binary()), ("counts", pa.binary()), ("vectors", pa.binary())])

    def lead(batches):
        for batch in batches:
            dims, out = batch["dim"].to_numpy(), np.zeros(len(batch))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                unit = _unit(_rows(batch["vector"].take(pa.array(at)), int(dim)))
                out[at] = unit @ axes[1][:, 0] if axes and axes[0] == dim else unit[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "lead"])

    def cut(batches):
        held, key = [], None

        def tile():
            vectors = np.array([r[2] for r in held])
            dim = vectors.shape[1]
            unit = _unit(vectors)
            place = (unit @ axes[1] if axes and axes[0] == dim else unit)[:, :BOX]
            node = np.array([r[0] for r in held], "<i8")
            row = {"tile": f"{key[0]}/{dim}/{node[0]}", "label": key[0], "dim": dim, "low": place.min(axis=0), "high": place.max(axis=0), "nodes": node.tobytes(), "counts": np.array([r[1] for r in held], "<i8").tobytes(), "vectors": vectors.astype("<f8").tobytes()}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for node, count, label, dim, vector in zip(*(batch[c].to_pylist() for c in ("node", "copies", "label", "dim")), batch["vector"]):
                if held and ((label, dim) != key or len(held) == TILE):
                    yield tile()
                    held = []
                key = (label, dim)
                held.append((node, count, vector.values.to_numpy()))
        if held:
            yield tile()

    fields = "node long, copies long, label string, dim int, vector array<double>"
    led = nodes.select("node", "copies", F.col("label").cast("string").alias("label"), "dim", "vector").mapInArrow(lead, fields + ", lead double")
    ordered = led.repartitionByRange("label", "dim", "lead").sortWithinPartitions("label", "dim", "lead", "node")
    return ordered.select("node", "copies", "label", "dim", "vector").mapInArrow(cut, "tile string, label string, dim int, low array<double>, high array<double>, nodes binary, counts binary, vectors binary")


def tile_links(tiles: DataFrame, axes, cosine: float) -> DataFrame:
    """node, links, root: per tile pair and node with links the number of linked vectors, and a node of its component."""
    side = lambda n: tiles.select("label", "dim", *(F.col(c).alias(f"{c}_{n}") for c in ("tile", "low", "high")))
    gap = F.aggregate(
        F.zip_with(F.zip_with("low_a", "high_b", lambda x, y: F.greatest(x - y, F.lit(0.0))), F.zip_with("low_b", "high_a", lambda x, y: F.greatest(x - y, F.lit(0.0))), lambda x, y: x * x + y * y),
        F.lit(0.0), lambda s, x: s + x,
    )
    near = side("a").join(side("b"), ["label", "dim"]).filter((F.col("tile_a") <= F.col("tile_b")) & (gap <= 2 - 2 * cosine + NEAR)).select("tile_a", "tile_b", "dim")
    load = lambda n: tiles.select(F.col("tile").alias(f"tile_{n}"), *(F.col(c).alias(f"{c}_{n}") for c in ("nodes", "counts", "vectors")))
    loaded = saved(near, "tile-pairs").join(load("a"), "tile_a").join(load("b"), "tile_b")

    def compare(batches):
        for batch in batches:
            for r in range(len(batch)):
                row = {c: batch[c][r] for c in batch.schema.names}
                dim, same = row["dim"].as_py(), row["tile_a"] == row["tile_b"]
                node, count, vectors = ({s: np.frombuffer(row[f"{c}_{s}"].as_buffer(), t) for s in "ab"} for c, t in (("nodes", "<i8"), ("counts", "<i8"), ("vectors", "<f8")))
                a, b = vectors["a"].reshape(-1, dim), vectors["b"].reshape(-1, dim)
                rows, columns = linked_pairs(a, b, axes[1] if axes and axes[0] == dim else None, same, cosine)
                if not len(rows):
                    continue
                names, copies = (node["a"], count["a"]) if same else (np.concatenate([node[s] for s in "ab"]), np.concatenate([count[s] for s in "ab"]))
                columns = columns if same else columns + len(a)
                n = len(names)
                links = np.bincount(rows, copies[columns], n) + np.bincount(columns, copies[rows], n)
                at = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(names[at]), pa.array(links[at].astype(np.int64)), pa.array(names[_roots(n, rows, columns)][at])], ["node", "links", "root"])

    return loaded.mapInArrow(compare, "node long, links long, root long")


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))
    valid = F.col("label").isNotNull() & _valid("vector")
    keyed = rows.withColumns({"k1": F.when(valid, F.xxhash64("label", "vector")), "k2": F.when(valid, F.xxhash64(F.reverse("vector"), F.lit(1)))})
    ids = keyed.select("vec_id", "k1", "k2")
    grouped = keyed.filter("k1 is not null").groupBy("k1", "k2").agg(
        F.min("vec_id").alias("rep_id"), F.count(F.lit(1)).alias("copies"), F.first(F.struct("label", "vector")).alias("x")
    )
    nodes = grouped.select("k1", "k2", "rep_id", "copies", "x.label", "x.vector", F.size("x.vector").alias("dim"))
    nodes = saved(nodes.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    axes = principal_axes(nodes)
    found = saved(tile_links(saved(_tiles(nodes, axes), "tiles"), axes, cosine), "tile-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = saved(components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))), "labels")
    named = nodes.select("k1", "k2", "node", "rep_id", "copies").join(links, "node", "left").join(labels, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("rep_id").alias("component_id"))
    known = named.join(least, "component").select("k1", "k2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    linked = ids.filter("k1 is not null").join(known, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = ids.filter("k1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
