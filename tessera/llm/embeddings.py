"""Embedding near-duplicates: all pairs of one label at a cosine threshold, by PCA-ordered tiles.

Vectors are scaled to length 1 and turned by the principal axes of the whole
table, which keeps every dot product and puts most of it in the leading
dimensions. Rows of a label are cut into tiles in the order of the first
coordinate. Two tiles are compared if the intervals of that coordinate allow
the threshold at all; a comparison adds up the products of the leading
dimensions, bounds the rest of each pair by the product of the suffix norms,
and goes on only with rows that still have a pair that can reach the
threshold. Pairs that the sum then puts within rounding of the threshold are
computed once more from the vectors as given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, small, written
from .simhash import forest

#: Rows of a tile. Tiles of a label are paired, so a label of n rows gives (n / TILE)² / 2 comparisons.
TILE = 2_048
#: Dimensions that are added at a time.
STEP = 16
#: Sums within this distance of the threshold are computed again.
CLOSE = 1e-9


def unit_rows(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """row_no, vec_id, label, unit (binary doubles of the vector of length 1; null where it cannot link), dim."""
    types = dict(vectors.dtypes)

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs, dims = [], []
            for v in batch.column(3).to_pylist():
                x = np.array([np.nan if c is None else c for c in v or []], np.float64)
                largest = np.abs(x).max(initial=0.0)
                if len(x) and np.isfinite(x).all() and largest > 0:
                    x = x / largest
                    blobs.append((x / np.sqrt((x * x).sum())).tobytes())
                    dims.append(len(x))
                else:
                    blobs.append(None)
                    dims.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(blobs, pa.binary()), pa.array(dims, pa.int32())], names=["row_no", "vec_id", "label", "unit", "dim"])

    rows = vectors.select(F.monotonically_increasing_id().alias("row_no"), F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    return rows.mapInArrow(scale, f"row_no long, vec_id {types[id_col]}, label {types[label_col]}, unit binary, dim int")


def principal_axes(units: DataFrame, dim: int) -> np.ndarray:
    """The eigenvectors, largest first, of the second moments of all vectors of ``dim`` dimensions (dim² numbers reach the driver)."""

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = np.frombuffer(b"".join(batch["unit"]), np.float64).reshape(-1, dim)
            total += x.T @ x
        yield pd.DataFrame({"bin": [TaskContext.get().partitionId() % 16], "m": [total.tobytes()]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"m": [np.sum([np.frombuffer(m, np.float64) for m in group["m"]], axis=0).tobytes()]})

    parts = units.filter(F.col("dim") == dim).select("unit").mapInPandas(moments, "bin int, m binary")
    sums = [np.frombuffer(bytes(r["m"]), np.float64) for r in parts.groupBy("bin").applyInPandas(add, "m binary").collect()]
    total = np.sum(sums, axis=0).reshape(dim, dim) if sums else np.eye(dim)
    return np.linalg.eigh(total)[1][:, ::-1].copy()


def tile_matches(x: np.ndarray, y: np.ndarray, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) with cosine of x[i], y[j] at the threshold or more."""
    p, q = x @ axes, y @ axes
    rows, columns = np.arange(len(p)), np.arange(len(q))
    total = np.zeros((len(p), len(q)))
    dim = p.shape[1]
    for k in range(0, dim, STEP):
        total += p[:, k : k + STEP] @ q[:, k : k + STEP].T
        after = k + STEP
        if after >= dim:
            break
        bound = np.sqrt((p[:, after:] ** 2).sum(1))[:, None] * np.sqrt((q[:, after:] ** 2).sum(1))[None, :]
        possible = total + bound >= threshold - CLOSE
        r, c = possible.any(1), possible.any(0)
        if not r.any():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        if r.mean() < 0.7 or c.mean() < 0.7:
            p, q, rows, columns, total = p[r], q[c], rows[r], columns[c], total[np.ix_(r, c)]
    i, j = np.nonzero(total >= threshold - CLOSE)
    sums, i, j = total[i, j], rows[i], columns[j]
    unsure = np.abs(sums - threshold) <= CLOSE
    if unsure.any():
        sums[unsure] = (x[i[unsure]] * y[j[unsure]]).sum(1)
    good = sums >= threshold
    return i[good], j[good]


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Link vectors of equal label at a cosine of ``threshold`` or more.

    Returns one row per input row: vec_id, n_links (other rows linked
    directly), component_id (smallest vec_id reachable), kept.

    * Rows with a null label, and vectors that are null, empty, zero or hold a null or non-finite
      component, link with nothing: n_links 0, component_id their own id.
    * Vectors of different lengths never link. Repeated rows link with each other like any others;
      of rows that share an id, each counts as a row.
    * A null id is above every id, so a group shows one only if it has no other; kept is then false.
    * An empty table gives an empty result. Other columns, whatever their names, are not read.

    Pairs are counted and joined to groups inside a tile comparison; no pair leaves it.
    """
    units = written(unit_rows(vectors, id_col, vector_col, label_col), "embedding-units")
    able = units.filter("unit IS NOT NULL AND label IS NOT NULL")
    dims = [r["dim"] for r in able.select("dim").distinct().collect()]
    axes = {d: principal_axes(able, d) for d in dims}

    def leading(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            first = [float(np.frombuffer(u, np.float64) @ axes[d][:, 0]) for u, d in zip(batch["unit"], batch["dim"])]
            yield batch[["row_no", "label", "dim", "unit"]].assign(lead=first)

    label_type = dict(able.dtypes)["label"]
    led = able.mapInPandas(leading, f"row_no long, label {label_type}, dim int, unit binary, lead double")
    led = written(led, "embedding-led")
    # Tiles: ranges of the first coordinate, from approximate quantiles of each label; ties are dealt by a hash.
    sizes = led.groupBy("label", "dim").agg(F.count("*").alias("n"), F.min("lead").alias("low"), F.max("lead").alias("high"))
    sizes = sizes.withColumn("cuts", F.ceil(F.col("n") / TILE))
    quantiles = led.groupBy("label", "dim").agg(F.percentile_approx("lead", [i / 64 for i in range(1, 64)], 2000).alias("q"))
    keyed = led.join(small(quantiles.join(sizes, ["label", "dim"]).select("label", "dim", "q", "cuts")), ["label", "dim"])
    stripe = F.expr("size(filter(q, e -> e < lead))")
    per = F.greatest(F.lit(1), F.ceil(F.col("cuts") / 64))
    coarse = F.floor(stripe * F.least("cuts", F.lit(64)) / 64)
    tiles = keyed.select("row_no", "label", "dim", "unit", "lead", (coarse * 1_000_000 + F.pmod(F.xxhash64("row_no"), per)).alias("tile"))
    tiles = written(tiles, "embedding-tiles")
    spans = written(tiles.groupBy("label", "dim", "tile").agg(F.min("lead").alias("low"), F.max("lead").alias("high")), "embedding-spans")

    # cos(x, y) <= cos(angle between the first coordinates): tiles whose angles lie too far apart have no pair.
    reach = float(np.arccos(min(1.0, max(-1.0, threshold)))) + 1e-9
    left, right = spans.alias("l"), spans.alias("r")
    angle = lambda c: F.acos(F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0)))
    pairs = left.join(right, (F.col("l.label") == F.col("r.label")) & (F.col("l.dim") == F.col("r.dim")) & (F.col("l.tile") <= F.col("r.tile")))
    pairs = pairs.filter((angle(F.col("l.high")) - angle(F.col("r.low")) <= reach) & (angle(F.col("r.high")) - angle(F.col("l.low")) <= reach))
    pairs = pairs.select(F.col("l.label").alias("label"), F.col("l.dim").alias("dim"), F.col("l.tile").alias("a"), F.col("r.tile").alias("b"))
    ends = pairs.select("*", F.explode(F.array_distinct(F.array("a", "b"))).alias("tile"))
    dealt = tiles.join(small(ends), ["label", "dim", "tile"])

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        dim, one, two = int(group["dim"].iat[0]), int(group["a"].iat[0]), int(group["b"].iat[0])
        group = group.sort_values("row_no")
        x, y = group[group["tile"] == one], group[group["tile"] == two]
        ids = np.unique(group["row_no"].to_numpy())
        px, py = (np.searchsorted(ids, t["row_no"].to_numpy()) for t in (x, y))
        ux, uy = (np.frombuffer(b"".join(t["unit"]), np.float64).reshape(-1, dim) for t in (x, y))
        count = np.zeros(len(ids), np.int64)
        a, b = np.empty(0, np.int64), np.empty(0, np.int64)
        for s in range(0, len(ux), 1024):
            for t in range(0, len(uy), 1024):
                i, j = tile_matches(ux[s : s + 1024], uy[t : t + 1024], axes[dim], threshold)
                i, j = px[i + s], py[j + t]
                i, j = i[i != j], j[i != j]
                if len(i):
                    count += np.bincount(i, minlength=len(ids))
                    if one != two:
                        count += np.bincount(j, minlength=len(ids))
                    root = forest(len(ids), np.concatenate((a, i)), np.concatenate((b, j)))
                    a = np.nonzero(root != np.arange(len(ids)))[0]
                    b = root[a]
        near = ids.copy()
        near[a] = ids[b]
        some = count > 0
        return pd.DataFrame({"row_no": ids[some], "links": count[some], "near": near[some]})

    matched = dealt.groupBy("label", "dim", "a", "b").applyInPandas(compare, "row_no long, links long, near long")
    matched = written(matched, "embedding-links")
    linked = matched.groupBy("row_no").agg(F.sum("links").alias("n_links"))
    edges = matched.filter("near <> row_no").select(F.col("row_no").alias("a"), F.col("near").alias("b"))
    grouped = components(edges, "embedding").withColumnRenamed("node", "row_no")

    rows = units.select("row_no", "vec_id").join(linked, "row_no", "left").join(grouped, "row_no", "left")
    rows = rows.select("row_no", "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "root")
    rooted = rows.filter("root IS NOT NULL")
    least = rooted.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    rooted = rooted.join(least, "root").select("vec_id", "n_links", "component_id")
    alone = rows.filter("root IS NULL").select("vec_id", "n_links", F.col("vec_id").alias("component_id"))
    return rooted.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
