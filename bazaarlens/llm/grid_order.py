"""Embedding near-duplicates by the epsilon grid order join.

Unit vectors with a cosine of t or more lie within eps = sqrt(2 - 2t) of each other. Vectors are
projected on their leading principal directions, which shortens distances only, and sorted by label
and by the grid cells (of width eps) of the projections. The sorted sequence is cut into blocks.
Two blocks are joined only where the boxes of their projections come within eps; inside a pair of
blocks the intervals are halved recursively, provably distant ones are skipped, and the last ones
are compared by all their coordinates in double precision.

Equal vectors of one label are one class with a weight, so a vector that many rows share costs no more than
one. A pair of blocks reports sums of links for each class and a spanning forest of its links, never the
pairs. The directions are fitted on a bounded sample (`fit_rows` classes in the order of a hash);
they decide speed, not results.

Vectors link only if labels are equal and not null and lengths agree. Null or zero vectors, and those with
null or non-finite components, link with nothing: n_links 0, component_id their vec_id. Repeated rows are
vectors of their own. A class whose vec_ids are all null has a null component_id.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarlens.llm.common import hash_first, stored
from bazaarlens.llm.components import components

DIRECTIONS = 6
BLOCK_ROWS = 2048
BLOCK_BYTES = 1 << 20
LEAF = 128
#: Keeps rounding from skipping a pair at the threshold.
MARGIN = 1e-6


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Vectors in double precision, None where a vector cannot link."""
    out: list[np.ndarray | None] = []
    for v in column.to_pylist():
        a = None if v is None or None in v else np.array(v, np.float64)
        if a is not None and (not len(a) or not np.isfinite(a).all() or not a.any()):
            a = None
        out.append(a)
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows divided by their lengths; scaled first, so that no square overflows or vanishes."""
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _described(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, size (null if the vector cannot link), and 128 bits that tell vectors apart."""
    schema = T.StructType(
        [T.StructField("vec_id", T.LongType()), T.StructField("label", T.LongType()), T.StructField("size", T.IntegerType())]
        + [T.StructField(c, T.LongType()) for c in ("low", "high")]
        + [T.StructField("vector", T.BinaryType())]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                rows = batch.slice(a, 4096)
                labels = rows.column("label").to_pylist()
                vectors = [None if k is None else v for k, v in zip(labels, _vectors(rows.column("embedding")))]
                # adding 0 turns a negative zero into a plain one
                packed = [None if v is None else (v + 0.0).tobytes() for v in vectors]
                whole = [0 if p is None else xxhash.xxh128_intdigest(p) for p in packed]
                bits = (1 << 64) - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("vec_id"),
                        pa.array(labels, pa.int64()),
                        pa.array([None if v is None else len(v) for v in vectors], pa.int32()),
                        pa.array(np.array([w & bits for w in whole], np.uint64).view(np.int64)),
                        pa.array(np.array([w >> 64 for w in whole], np.uint64).view(np.int64)),
                        pa.array(packed, pa.binary()),
                    ],
                    names=schema.names,
                )

    columns = (F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    return embeddings.select(*columns).mapInArrow(run, schema)


def leading_directions(sample: np.ndarray, most: int = DIRECTIONS) -> np.ndarray:
    """Orthonormal columns along which a sample of unit vectors spreads most."""
    centred = sample - sample.mean(0)
    _, vectors = np.linalg.eigh(centred.T @ centred)
    return np.ascontiguousarray(vectors[:, ::-1][:, : min(most, sample.shape[1])])


def _directions(classes: DataFrame, fit_rows: int) -> dict[int, np.ndarray]:
    rows = hash_first(classes.select("class", "size", "vector"), "class", fit_rows).toArrow()
    found: dict[int, list[np.ndarray]] = {}
    for size, vector in zip(rows.column("size").to_pylist(), rows.column("vector").to_pylist()):
        found.setdefault(size, []).append(np.frombuffer(vector))
    return {size: leading_directions(unit(np.stack(v))) for size, v in found.items()}


def project(rows: np.ndarray, directions: dict[int, np.ndarray]) -> np.ndarray:
    """Projections on the directions of their length (the first coordinates where none were fitted)."""
    known = directions.get(rows.shape[1])
    out = np.zeros((len(rows), DIRECTIONS))
    found = rows[:, :DIRECTIONS] if known is None else rows @ known
    out[:, : found.shape[1]] = found
    return out


BOX = [T.StructField(c, T.ArrayType(T.DoubleType(), False)) for c in ("low", "high")]
BLOCK = T.StructType(
    [T.StructField("block", T.LongType()), T.StructField("label", T.LongType()), T.StructField("size", T.IntegerType()), *BOX]
    + [T.StructField(c, T.BinaryType()) for c in ("ids", "weights", "vectors")]
)


def _blocks(classes: DataFrame, directions: dict[int, np.ndarray], eps: float) -> DataFrame:
    """Blocks of the sequence in grid order, with the boxes of their projections."""
    cells = [f"c{i}" for i in range(DIRECTIONS)]
    schema = T.StructType([*classes.schema.fields, *(T.StructField(c, T.IntegerType()) for c in cells)])

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array(batch.column("size").to_pylist())
            out = np.zeros((batch.num_rows, DIRECTIONS), np.int32)
            vectors = batch.column("vector").to_pylist()
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                rows = unit(np.stack([np.frombuffer(vectors[i]) for i in at.tolist()]))
                out[at] = np.floor(project(rows, directions) / eps)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c) for c in out.T.copy())], names=schema.names)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, sizes = (np.array(batch.column(c).to_pylist()) for c in ("label", "size"))
            ids, weights = batch.column("class").to_numpy(), batch.column("weight").to_numpy()
            vectors = batch.column("vector").to_pylist()
            edge = np.flatnonzero((labels[1:] != labels[:-1]) | (sizes[1:] != sizes[:-1])) + 1
            for a, b in zip(np.r_[0, edge].tolist(), np.r_[edge, len(labels)].tolist()):
                most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * int(sizes[a])))) if b > a else 1
                for s in range(a, b, most):
                    e = min(s + most, b)
                    rows = unit(np.stack([np.frombuffer(v) for v in vectors[s:e]]))
                    shadow = project(rows, directions)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([int(ids[s])]),
                            pa.array([int(labels[s])]),
                            pa.array([int(sizes[s])], pa.int32()),
                            pa.array([shadow.min(0).tolist()]),
                            pa.array([shadow.max(0).tolist()]),
                            pa.array([ids[s:e].tobytes()]),
                            pa.array([weights[s:e].tobytes()]),
                            pa.array([b"".join(vectors[s:e])]),
                        ],
                        names=BLOCK.names,
                    )

    order = ["label", "size", *cells, "class"]
    placed = classes.mapInArrow(place, schema)
    parts = max(1, int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop(*cells).mapInArrow(cut, BLOCK)


def block_pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """(left, right) of blocks of one label whose boxes come within eps, each pair once.

    Blocks meet by the cells that they cover along the first direction.
    """
    boxes = blocks.select("block", "label", "size", "low", "high")

    def cells(low, high):
        return F.explode(F.sequence(F.floor(low / eps), F.floor(high / eps)))

    left = boxes.select("*", cells(F.col("low")[0], F.col("high")[0]).alias("cell"))
    right = boxes.select(
        F.col("block").alias("other"),
        "label",
        "size",
        F.col("low").alias("other_low"),
        F.col("high").alias("other_high"),
        cells(F.col("low")[0] - eps, F.col("high")[0] + eps).alias("cell"),
    )
    gap = sum(
        (
            F.pow(F.greatest(F.col("low")[i] - F.col("other_high")[i], F.col("other_low")[i] - F.col("high")[i], F.lit(0.0)), 2)
            for i in range(DIRECTIONS)
        ),
        F.lit(0.0),
    )
    # the first block of the pair is the smaller one, whichever of them the cells named first
    return (
        left.join(right, ["label", "size", "cell"])
        .where(gap <= eps * eps)
        .select(F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"))
        .distinct()
    )


class PairJoin:
    """Recursive join of two blocks (or of one with itself)."""

    def __init__(self, a: np.ndarray, b: np.ndarray | None, shadows: tuple[np.ndarray, np.ndarray], least: float, eps: float):
        self.a, self.b, self.same = a, a if b is None else b, b is None
        self.sa, self.sb = shadows
        self.least, self.reach = least, eps * eps
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        self.boxes: list[dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]] = [{}, {}]

    def box(self, side: int, s: int, e: int):
        key = (s, e)
        if key not in self.boxes[side]:
            part = (self.sa, self.sb)[side][s:e]
            self.boxes[side][key] = part.min(0), part.max(0)
        return self.boxes[side][key]

    def join(self, s: int, e: int, t: int, f: int) -> None:
        if self.same and f <= s:
            return  # the mirror image is joined
        (la, ha), (lb, hb) = self.box(0, s, e), self.box(1, t, f)
        gap = np.maximum(np.maximum(la - hb, lb - ha), 0)
        if gap @ gap > self.reach:
            return
        if e - s <= LEAF and f - t <= LEAF:
            hits = self.a[s:e] @ self.b[t:f].T >= self.least
            i, j = np.nonzero(hits)
            i, j = i + s, j + t
            if self.same:
                i, j = i[i < j], j[i < j]
            if len(i):
                self.found.append((i, j))
            return
        if e - s >= f - t:
            m = (s + e) // 2
            self.join(s, m, t, f)
            self.join(m, e, t, f)
        else:
            m = (t + f) // 2
            self.join(s, e, t, m)
            self.join(s, e, m, f)


def forest(left: np.ndarray, right: np.ndarray, nodes: int) -> np.ndarray:
    """Least node of the component of each node."""
    root = np.arange(nodes)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def join_blocks(left: dict, right: dict | None, directions: dict[int, np.ndarray], least: float, eps: float):
    """Sums of weights linked to each class, and links of a spanning forest, of a pair of blocks."""

    def read(block):
        rows = unit(np.frombuffer(block["vectors"]).reshape(-1, block["size"]))
        return np.frombuffer(block["ids"], np.int64), np.frombuffer(block["weights"], np.int64), rows, project(rows, directions)

    ids, weights, a, sa = read(left)
    n = len(ids)
    if right is None:
        pair = PairJoin(a, None, (sa, sa), least, eps)
        pair.join(0, n, 0, n)
        base = 0
    else:
        ids2, weights2, b, sb = read(right)
        pair = PairJoin(a, b, (sa, sb), least, eps)
        pair.join(0, n, 0, len(ids2))
        ids, weights, base = np.r_[ids, ids2], np.r_[weights, weights2], n
    if not pair.found:
        return ids[:0], weights[:0], ids[:0], ids[:0]
    i = np.concatenate([x for x, _ in pair.found])
    j = np.concatenate([y for _, y in pair.found]) + base
    degree = np.zeros(len(ids), np.int64)
    np.add.at(degree, i, weights[j])
    np.add.at(degree, j, weights[i])
    root = forest(i, j, len(ids))
    own = np.flatnonzero(root != np.arange(len(ids)))
    some = np.flatnonzero(degree)
    return ids[some], degree[some], ids[own], ids[root[own]]


FOUND = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("links", T.LongType())])


def near_duplicates(embeddings: DataFrame, least: float = 0.98, fit_rows: int = 4096) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row."""
    eps = float(np.sqrt(max(2 - 2 * least, 0))) + MARGIN
    described = stored(_described(embeddings), "embedding-rows")
    key = ["label", "size", "low", "high"]
    rows = described.drop("vector").withColumn("class", F.when(F.col("size").isNotNull(), F.xxhash64(*key)))
    classes = stored(
        described.where(F.col("size").isNotNull())
        .groupBy(*key)
        .agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("leader"), F.first("vector").alias("vector"))
        .select(F.xxhash64(*key).alias("class"), "label", "size", "weight", "leader", "vector"),
        "embedding-classes",
    )
    directions = _directions(classes, fit_rows)
    blocks = stored(_blocks(classes.drop("leader"), directions, eps), "grid-blocks")
    held = blocks.select("block", "size", "ids", "weights", "vectors")

    def side(name: str) -> DataFrame:
        return held.select(F.col("block").alias(name), F.struct("size", "ids", "weights", "vectors").alias(f"{name}_block"))

    pairs = stored(block_pairs(blocks, eps), "block-pairs")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one pair at a time: its blocks are bounded
                left = batch.column("left_block")[i].as_py()
                own = batch.column("left")[i].as_py() == batch.column("right")[i].as_py()
                right = None if own else batch.column("right_block")[i].as_py()
                a, links, b, c = join_blocks(left, right, directions, least, eps)
                n, m = len(a), len(b)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.r_[a, b].astype(np.int64)),
                        pa.array(np.r_[np.zeros(n, np.int64), c], mask=np.r_[np.ones(n, bool), np.zeros(m, bool)]),
                        pa.array(np.r_[links, np.zeros(m, np.int64)], mask=np.r_[np.zeros(n, bool), np.ones(m, bool)]),
                    ],
                    names=FOUND.names,
                )

    joined = pairs.join(side("left"), "left").join(side("right"), "right")
    found = stored(joined.select("left", "right", "left_block", "right_block").mapInArrow(run, FOUND), "embedding-links")
    degrees = found.where(F.col("links").isNotNull()).groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    linked = components(found.where(F.col("b").isNotNull()).select("a", "b")).withColumnRenamed("node", "class")
    owned = (
        classes.select("class", "weight", "leader")
        .join(degrees, "class", "left")
        .join(linked, "class", "left")
        .withColumn("component", F.coalesce("component", "class"))
    )
    least_id = owned.groupBy("component").agg(F.min("leader").alias("component_id"))
    named = stored(
        owned.join(least_id, "component").select(
            "class", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"
        ),
        "embedding-components",
    )
    return rows.join(named, "class", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce(F.col("class").isNull() | (F.col("vec_id") == F.col("component_id")), F.lit(False)).alias("kept"),
    )
