"""Near-duplicate vectors by cosine, with randomised-rotation binary codes.

A vector is normalised and turned by a fixed random rotation; the signs of the
result are its code. With the code is stored the correction factor
f = <code, rotated vector>, where the code is scaled to unit length. For any
other unit vector y, <code, rotated y> / f estimates the cosine without bias,
and its error stays, but for a chance that falls with EPSILON, within
sqrt((1 - f^2) / f^2) * EPSILON / sqrt(D - 1). Pairs whose upper bound lies
below the threshold are dropped on codes alone; all others are computed again
in double precision, and only that decides a link.

Candidates come from the signs of further rotations: ``tables`` keys of
``bits`` signs each. Two vectors at the threshold's angle share no key with a
chance of at most MISS, which sets the number of tables; the number of bits
follows from the number of vectors, so that chance meetings stay few at any
size. Equal vectors are one node. Keys of a single node go before any vector
is moved; the nodes of a larger key are cut into blocks, and a task compares
two blocks and returns counts and a forest of links, never pairs.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm import shared
from tidelog.llm.components import components

THRESHOLD = 0.98
#: Chance that a pair at the threshold shares no key, as if the signs of a key were independent (rows of one rotation are nearly so).
MISS = 1e-7
#: Width of the confidence bound; a bound fails with a chance of about exp(-EPSILON^2 / 2), which adds to MISS.
EPSILON = 6.0
#: Nodes of a key that one side of a comparison holds at most, about.
BLOCK = 1024


@functools.lru_cache(64)
def rotation(dim: int, number: int) -> np.ndarray:
    """The random rotation of that number, the same in every task."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64([dim, number, 4711])).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def plan(nodes: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Bits of a key and number of tables for so many nodes."""
    bits = max(8, math.ceil(math.log2(max(nodes, 2))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log1p(-same))


def _unit(columns: pa.Array) -> np.ndarray:
    x = columns.values.to_numpy(zero_copy_only=False).astype(np.float64)[columns.offsets[0].as_py() : columns.offsets[-1].as_py()]
    x = x.reshape(len(columns), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _all_keys(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Keys of each vector, a column for each table."""
    dim = x.shape[1]
    need = bits * tables
    signs = np.empty((len(x), -(-need // dim) * dim), bool)
    for r in range(signs.shape[1] // dim):
        signs[:, r * dim : (r + 1) * dim] = x @ rotation(dim, r + 1).T > 0
    weights = np.left_shift(np.int64(1), np.arange(bits, dtype=np.int64))
    return (signs[:, :need].reshape(len(x), tables, bits) * weights).sum(2)


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of a batch by the length of their vectors."""
    lengths = np.diff(batch.column(1).offsets.to_numpy())
    for dim in np.unique(lengths):
        part = batch.filter(pa.array(lengths == dim))
        yield part, _unit(part.column(1))


def _key_rows(bits: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _by_dim(batch):
                keys = _all_keys(x, bits, tables)
                n = len(x)
                # the label and the length of the vector are parts of a key
                spot = np.tile(np.arange(tables, dtype=np.int32), n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(part.column(0).to_numpy(), tables)), pa.array(np.repeat(part.column(2).to_numpy(), tables)), pa.array(np.full(n * tables, x.shape[1], np.int32)), pa.array(spot), pa.array(keys.ravel())],
                    ["node", "label", "dim", "spot", "key"],
                )

    return run


def _compare(x: np.ndarray, y: np.ndarray, dim: int, threshold: float, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) whose exact cosine reaches the threshold, after the bounds on codes have dropped most; with an infinite ``epsilon`` none are."""
    if epsilon == math.inf:
        i, j = np.nonzero(x @ y.T >= threshold - 1e-9)
    else:
        turn = rotation(dim, 0).T
        rx, ry = x @ turn, y @ turn
        code = np.where(rx > 0, 1.0, -1.0) / math.sqrt(dim)
        factor = (code * rx).sum(1)
        estimate = (code.astype(np.float32) @ ry.T.astype(np.float32)) / factor[:, None]
        bound = np.sqrt(np.maximum(1 - factor**2, 0)) / factor * epsilon / math.sqrt(max(dim - 1, 1)) + 1e-4
        i, j = np.nonzero(estimate + bound[:, None] >= threshold)
    keep = np.zeros(len(i), bool)
    for a in range(0, len(i), 1 << 16):
        b = slice(a, a + (1 << 16))
        keep[b] = np.einsum("ij,ij->i", x[i[b]], y[j[b]]) >= threshold
    return i[keep], j[keep]


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while (up := root.get(v, v)) != v:
            root[v] = root.get(up, up)
            v = root[v]
        return v

    found = []
    for u, v in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(u), find(v)
        if p != q:
            root[max(p, q)] = min(p, q)
            found.append((u, v))
    return found


def _links(threshold: float, bits: int, tables: int):
    """Compare the blocks of one key after another, from rows in order of their key."""

    def group(rows: list[pa.RecordBatch]) -> list[tuple[int, int, int]]:
        part = pa.Table.from_batches(rows).combine_chunks()
        node, copies = part.column("node").to_numpy(), part.column("copies").to_numpy()
        mine, i, j = part.column("part").to_numpy(), part.column("i")[0].as_py(), part.column("j")[0].as_py()
        spot = part.column("spot")[0].as_py()
        x = _unit(part.column("embedding").combine_chunks())
        keys = _all_keys(x, bits, tables)[:, :spot] if spot else np.zeros((len(x), 0), np.int64)
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        a, b = _compare(x[left], x[right], x.shape[1], threshold, EPSILON if bits else math.inf)
        a, b = left[a], right[b]
        if i == j:
            a, b = a[a < b], b[a < b]
        # a pair counts in the first table that holds it
        fresh = np.ones(len(a), bool)
        for k in range(0, len(a), 1 << 15):
            c = slice(k, k + (1 << 15))
            fresh[c] = ~(keys[a[c]] == keys[b[c]]).any(1)
        a, b = a[fresh], b[fresh]
        if not len(a):
            return []
        n = np.bincount(a, weights=copies[b], minlength=len(x)) + np.bincount(b, weights=copies[a], minlength=len(x))
        out = [(int(node[k]), int(n[k]), int(node[k])) for k in np.flatnonzero(n)]
        return out + [(u, 0, v) for u, v in _forest(node[a], node[b])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, out = [], None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            at = [np.asarray(batch.column(batch.schema.get_field_index(c)).to_numpy()) for c in ("label", "dim", "spot", "key", "i", "j")]
            change = np.zeros(batch.num_rows, bool)
            for c in at:
                change[1:] |= c[1:] != c[:-1]
            starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                this = tuple(int(c[s]) for c in at)
                if this != last and held:
                    out += group(held)
                    held = []
                held.append(batch.slice(s, e - s))
                last = this
            if len(out) > 1 << 16:
                yield _result(out)
                out = []
        if held:
            out += group(held)
        yield _result(out)

    return run


def _result(out: list[tuple[int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) if out else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "n", "b"])


def _usable(embedding: Column, label: Column) -> Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & (F.size(embedding) > 0) & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, exact: bool = False) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, a row for each row of ``vectors``.

    Vectors link when their labels are equal and their cosine reaches
    ``threshold``. Vectors that are null, empty or zero, hold a null or
    non-finite component, or have no label or no id link with nothing: they
    count no links and are their own component. Each row is a vector, so equal
    vectors link with one another, and a repeated row counts as another vector.
    Vectors of different lengths do not link. Other columns are not read.

    A pair at the threshold is missed with a chance of about MISS plus that of
    its bound. With ``exact`` all vectors of a label are compared, in blocks,
    in double precision: nothing is missed, and the work grows with the square
    of a label's different vectors. Equal vectors are told by a 64-bit hash.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    ok = _usable(F.col("embedding"), F.col("label")) & F.col("vec_id").isNotNull()
    plain = F.transform("embedding", lambda x: x + F.lit(0.0))  # -0.0 becomes 0.0
    good = rows.where(ok).withColumn("embedding", plain).withColumn("node", F.xxhash64("label", "embedding"))
    # Equal vectors are one node: its number, its copies and its least id.
    nodes = good.groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first"))
    nodes = shared.table(nodes, "nodes")
    n = nodes.count()
    bits, tables = (0, 1) if exact else plan(n, threshold)
    one = good.join(nodes, "node").where("vec_id = first").select("node", "embedding", "label", "copies").dropDuplicates(["node"])
    one = shared.table(one, "vectors")

    place = ["label", "dim", "spot", "key"]
    keyed = one.select("node", "embedding", "label").mapInArrow(_key_rows(bits, tables), "node long, label long, dim int, spot int, key long")
    keyed = shared.table(keyed, "keys")
    met = keyed.groupBy(*place).agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    met = met.withColumn("parts", F.ceil(F.col("members") / BLOCK).cast("int"))
    members = keyed.join(met.drop("members"), place).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    members = members.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o"))
    members = members.select("node", *place, "part", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"))
    work = members.join(one.select("node", "embedding", "copies"), "node")
    order = [*place, "i", "j"]
    found = work.repartition(*order).sortWithinPartitions(*order).mapInArrow(_links(threshold, bits, tables), "a long, n long, b long")
    found = shared.table(found, "links")
    shared.drop(keyed, one)

    joined = components(found.where("a <> b").select("a", "b"))
    counts = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    label = nodes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = label.groupBy("component").agg(F.min("first").alias("component_id"))
    answer = label.join(least, "component").join(counts, "node", "left").select("node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = good.select("vec_id", "node").join(answer, "node").select("vec_id", "n_links", "component_id")
    rest = rows.where(~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
