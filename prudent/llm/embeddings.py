"""Near-duplicate vectors by Euclidean p-stable hashing, confirmed by exact cosine.

Vectors are normalised, so cosine >= c means a distance <= sqrt(2 - 2c).  A hash is
``floor((g . x + u) / w)`` with Gaussian ``g`` and uniform ``u``; a table's bucket is the tuple of
``k`` hashes, and there are as many tables as bring a pair at the threshold together with the
wanted recall.  Buckets of one vector are dropped before any vector is shuffled.

Inside a bucket a kernel compares chunks of at most ``CHUNK`` vectors with each other; a bucket
of more is dealt as pairs of chunks, so no task holds a large bucket.  A pair of vectors counts in
the first table that they share, and the kernel returns counts and a spanning forest, not pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prudent.llm.common import staged
from prudent.operators.graph import connected_components

CHUNK, WIDTH, RECALL, SEED = 1024, 2.0, 0.995, 77


def collision(distance: float, width: float) -> float:
    """Probability that one quantised Gaussian projection agrees at this distance."""
    t = width / distance
    return math.erf(t / math.sqrt(2)) - math.sqrt(2 / math.pi) / t * (1 - math.exp(-t * t / 2))


def table_plan(rows: int, cosine: float, width: float = WIDTH, recall: float = RECALL) -> tuple[int, int]:
    """Hashes per table and tables, from the number of vectors that are compared with each other.

    ``k`` makes an unrelated (orthogonal) vector rarely a bucket mate of a given one; the number of
    tables follows from the recall at the threshold.
    """
    near, far = (collision(math.sqrt(2 - 2 * c), width) for c in (cosine, 0.0))
    k = max(4, math.ceil(math.log(max(rows, 2)) / -math.log(far)))
    return k, math.ceil(math.log(1 - recall) / math.log(1 - near ** k))


def _projections(dim: int, k: int, tables: int, width: float, seed: int):
    rng = np.random.default_rng([seed, dim])
    return rng.standard_normal((dim, k * tables)), rng.uniform(0, width, k * tables)


def _hashes(k: int, tables: int, width: float, seed: int):
    def run(batches):
        made: dict = {}
        for batch in batches:
            ids, labels, vectors = (batch.column(i) for i in range(3))
            out: list = [None] * batch.num_rows
            fps: list = [None] * batch.num_rows
            raw: list = [None] * batch.num_rows
            by_dim: dict[int, list] = {}
            for i, v in enumerate(vectors):
                if ids[i].as_py() is None or labels[i].as_py() is None or not v.is_valid or not len(v.values) or v.values.null_count:
                    continue
                x = v.values.to_numpy()
                norm = math.sqrt(float(x @ x))
                if math.isfinite(norm) and norm > 0:
                    by_dim.setdefault(len(x), []).append((i, x, norm))
            for dim, rows in by_dim.items():
                if dim not in made:
                    made[dim] = _projections(dim, k, tables, width, seed)
                g, u = made[dim]
                x = np.array([r[1] for r in rows])
                cells = np.floor((x / np.array([r[2] for r in rows])[:, None] @ g + u) / width).astype(np.int32)
                cells = cells.reshape(len(rows), tables, k)
                for (i, one, _), cell in zip(rows, cells):
                    raw[i] = (one + 0.0).tobytes()
                    fps[i] = xxhash.xxh3_128_digest(labels[i].as_py().encode() + b"\0" + raw[i])
                    out[i] = np.array([xxhash.xxh64_intdigest(cell[t].tobytes(), seed=t * 65_536 + dim) for t in range(tables)],
                                      np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids, labels, pa.array(fps, pa.binary()), pa.array(raw, pa.binary()), pa.array(out, pa.list_(pa.int64()))],
                names=["vec_id", "label", "fp", "vector", "keys"])
    return run


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges (root, node) of a spanning star per component of the graph on 0..n-1, smallest node as root."""
    low = np.arange(n)
    while True:
        now = low.copy()
        np.minimum.at(now, a, low[b])
        np.minimum.at(now, b, low[a])
        now = now[now]
        if np.array_equal(now, low):
            return [(int(r), i) for i, r in enumerate(low) if r != i]
        low = now


def _pairs(cosine: float):
    """Kernel: rows of (label, key, chunk_a, chunk_b), sorted; a row says in which chunk it is."""
    def compare(key, rows):
        table, diagonal = rows[0][7], key[2] == key[3]
        ids = np.array([r[4] for r in rows])
        counts = np.array([r[8] for r in rows])
        sides = np.array([r[5] for r in rows])
        keys = np.array([r[9] for r in rows])
        x = np.array([np.frombuffer(r[6], np.float64) for r in rows])
        x = x / np.linalg.norm(x, axis=1)[:, None]
        left = np.flatnonzero(sides == key[2])
        right = left if diagonal else np.flatnonzero(sides == key[3])
        if not len(left) or not len(right):
            return None
        i, j = np.nonzero(x[left] @ x[right].T >= cosine)
        i, j = left[i], right[j]
        if diagonal:
            i, j = i[i < j], j[i < j]
        if not len(i):
            return None
        first = np.ones(len(i), bool)
        for at in range(0, len(i), 65_536):  # bounds the comparison of key prefixes
            part = slice(at, at + 65_536)
            first[part] = ~(keys[i[part], :table] == keys[j[part], :table]).any(axis=1)
        linked = np.bincount(i[first], counts[j[first]], len(rows)) + np.bincount(j[first], counts[i[first]], len(rows))
        forest = _forest(len(rows), i, j)
        return ids, [r[10] for r in rows], linked.astype(np.int64), [(ids[a], ids[b]) for a, b in forest]

    def run(batches):
        key, held = None, []

        def flush():
            got = compare(key, held) if len(held) > 1 else None
            if got is None:
                return None
            ids, fps, linked, forest = got
            some = np.flatnonzero(linked)
            u = [None] * len(some) + [a for a, _ in forest]
            v = [None] * len(some) + [b for _, b in forest]
            n = list(linked[some]) + [0] * len(forest)
            fp = [fps[i] for i in some] + [None] * len(forest)
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(n, pa.int64()),
                                               pa.array(fp, pa.binary())], names=["u", "v", "n", "cfp"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(11))):
                if row[:4] != key:
                    got = flush() if held else None
                    if got is not None:
                        yield got
                    key, held = row[:4], []
                held.append(row)
        got = flush() if held else None
        if got is not None:
            yield got
    return run


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                           cosine: float = 0.93, width: float = WIDTH, recall: float = RECALL, seed: int = SEED) -> DataFrame:
    """Links between vectors of one label with a cosine of ``cosine`` or more, in double precision.

    Returns per input row ``vec_id, n_links, component_id, kept``: the number of other rows linked
    directly, the smallest id reachable over links, and whether that is the row itself.  Links that
    are returned are exact; of the pairs at the threshold at least ``recall`` is expected to be found,
    more of closer ones.  Equal vectors of a label are one class and count with their multiplicity.

    Cases: a null label, a null, empty or zero vector, or one with null or non-finite components
    links with nothing (component is its own id); so does a row with a null id (component null,
    kept).  Repeated rows are vectors of their own and link with each other; they share their id.
    Vectors of different lengths never link.  Other columns are ignored.  An empty table gives an
    empty result.
    """
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
                          F.col(vector_col).cast("array<double>").alias("vector"))
    most = base.where("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    k, tables = table_plan(most, cosine, width, recall)
    rows = staged(base.mapInArrow(_hashes(k, tables, width, seed),
                                  "vec_id long, label string, fp binary, vector binary, keys array<long>"), "vectors")
    classes = staged(rows.where("fp IS NOT NULL").groupBy("fp")
                     .agg(F.min("label").alias("label"), F.min("vec_id").alias("id"), F.count("*").alias("copies"),
                          F.first(F.struct("vector", "keys")).alias("v")).select("fp", "label", "id", "copies", "v.*"),
                     "vector-classes")
    cells = classes.select(F.col("label").alias("l"), F.col("fp").alias("f"), F.posexplode("keys").alias("t", "key"))
    sized = staged(cells.groupBy("l", "t", "key").agg(F.count("*").alias("size")).where("size > 1"), "vector-buckets")
    chunks = F.ceil(F.col("size") / CHUNK).cast("long")
    zero = F.lit(0).cast("long")
    placed = (cells.join(sized.select(*[F.col(c).alias(f"s{c}") for c in ("l", "t", "key")], chunks.alias("chunks")),
                         (F.col("l") == F.col("sl")) & (F.col("t") == F.col("st")) & (F.col("key") == F.col("skey")))
              .select("l", "t", "key", "f", F.pmod(F.xxhash64("f"), F.col("chunks")).alias("chunk"), "chunks")
              .select("*", F.explode(F.sequence(zero, F.col("chunks") - 1)).alias("other")))
    dealt = (placed.join(classes, F.col("f") == F.col("fp"))
             .select("label", "key", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"),
                     "id", "chunk", "vector", "t", "copies", "keys", "fp")
             .repartition("label", "key", "a", "b").sortWithinPartitions("label", "key", "a", "b"))
    found = staged(dealt.mapInArrow(_pairs(cosine), "u long, v long, n long, cfp binary"), "vector-links")
    counts = found.where("cfp IS NOT NULL").groupBy("cfp").agg(F.sum("n").alias("links"))
    components = connected_components(found.where("u IS NOT NULL").select("u", "v").distinct())
    named = staged(classes.select("fp", "id", "copies")
                   .join(counts, F.col("fp") == F.col("cfp"), "left").join(components, F.col("id") == F.col("node"), "left")
                   .select(F.col("fp").alias("nfp"), (F.coalesce("links", zero) + F.col("copies") - 1).alias("n_links"),
                           F.coalesce("component", "id").alias("component")), "vectors-named")
    return (rows.select("vec_id", "fp").join(named, F.col("fp") == F.col("nfp"), "left")
            .select("vec_id", F.coalesce("n_links", zero).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"),
                    F.coalesce("component", "vec_id").eqNullSafe(F.col("vec_id")).alias("kept")))
