"""Cosine top-k over a vector table: exact scans and a cell index with an exact finish."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.session import checkpoint_dir
from lodestrata.functions.vectors import as_double, cosine_similarity, l2_normalize, norm

# Scores are compared after rounding, so that equal vectors tie whatever the summing order.
SCORE_DIGITS = 9
# Largest query matrix (rows x dimension x 8 bytes) that is handed to every task.
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
# Largest block of scores (rows x queries x 8 bytes) that a task holds at once.
SCORE_BLOCK_BYTES = 8 * 1024 * 1024
# Candidates (query, key, score) that wait in a task before they are cut to the best of each query.
WAITING = 1_000_000
# Fewest and most cells of an index; the table of their centres goes to every task.
CELLS = (16, 4096)


def vector_search(
    vectors: DataFrame, query: list[float], k: int = 10, condition: str | Column | None = None,
    vector: str = "vector", key: str = "id",
) -> DataFrame:
    """Best ``k`` rows for one query vector: filter, score, then a top-k per task and one merge.

    The filter runs before the
    top-k, so ``k`` hits come back whenever that many rows qualify.
    """
    rows = vectors
    if condition is not None:
        rows = rows.filter(F.expr(condition) if isinstance(condition, str) else condition)
    target = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.withColumn("score", F.round(cosine_similarity(F.col(vector), target), SCORE_DIGITS))
    return scored.filter(_scored()).orderBy(F.desc("score"), F.asc(key)).limit(k)


def _scored() -> Column:
    """A row without direction (null, zero or NaN vector) has no score and is no hit, on every path."""
    return F.col("score").isNotNull() & ~F.isnan("score")


def _query_matrix(queries: DataFrame, query_key: str, vector: str, limit_bytes: int):
    """The query side as (keys, unit matrix) if it is within the limit, else None."""
    size = queries.agg(
        F.count("*").alias("n"), F.coalesce(F.max(F.size(vector)), F.lit(0)).alias("dim")).first()
    if size["n"] * size["dim"] * 8 > limit_bytes:
        return None
    rows = queries.select(query_key, as_double(F.col(vector)).alias("v")).collect()
    keys = [r[0] for r in rows]
    matrix = np.array([r["v"] for r in rows], dtype=np.float64).reshape(len(rows), size["dim"])
    return keys, matrix


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.full_like(matrix, np.nan), where=norms > 0)


def _stack(values) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in values])


class Best:
    """The best ``k`` keys of each query seen by a task, with scores rounded to SCORE_DIGITS.

    Queries are numbers; ``least`` has the score that a hit of each needs, which rises as hits come. Candidates wait
    until there are WAITING of them and are then sorted at once, so memory is that and k hits a query,
    whatever the number of rows. With ``distinct`` a key counts once, at its best score.
    """

    def __init__(self, least: np.ndarray, k: int, distinct: bool = False):
        self.least, self.k, self.distinct = least, k, distinct
        self.parts, self.waiting = [], 0

    def offer(self, asked: np.ndarray, keys: np.ndarray, scores: np.ndarray) -> None:
        """Scores as queries x keys; NaN is no hit."""
        least = self.least[asked]
        new = np.isneginf(least)
        if new.any() and not self.distinct and 0 < self.k < len(keys):
            least[new] = np.partition(scores[new], -self.k, axis=1)[:, -self.k]
        # Twice the unit of rounding below: what rounds to the same score is kept.
        row, column = np.nonzero(scores >= least[:, None] - 2 * 10.0 ** -SCORE_DIGITS)
        self.parts.append((asked[row], keys[column], np.round(scores[row, column], SCORE_DIGITS)))
        self.waiting += len(row)
        if self.waiting > WAITING:
            self._cut()

    def _cut(self) -> None:
        asked, keys, scores = (np.concatenate(x) for x in zip(*self.parts))
        place = pd.factorize(keys, sort=True)[0]
        if not self.distinct:
            place[place < 0] = len(place)  # null keys stand last, as pandas sorts them
        order = np.arange(len(asked))
        if self.distinct and len(order):
            order = np.lexsort((-scores, place, asked))
            a, p = asked[order], place[order]
            order = order[np.r_[True, (a[1:] != a[:-1]) | (p[1:] != p[:-1])]]
        order = order[np.lexsort((place[order], -scores[order], asked[order]))]
        a = asked[order]
        start = np.flatnonzero(np.r_[len(a) > 0, a[1:] != a[:-1]][:len(a)])
        nth = np.arange(len(a)) - np.repeat(start, np.diff(np.r_[start, len(a)]))
        last = order[nth == self.k - 1]
        self.least[asked[last]] = np.maximum(self.least[asked[last]], scores[last])
        order = order[nth < self.k]
        self.parts, self.waiting = [(asked[order], keys[order], scores[order])], 0

    def frames(self, names: np.ndarray, query_key: str, key: str, rows: int = 100_000):
        if self.parts:
            self._cut()
            asked, keys, scores = self.parts[0]
            for i in range(0, len(asked), rows):
                yield pd.DataFrame({query_key: names[asked[i:i + rows]], key: keys[i:i + rows], "score": scores[i:i + rows]})


def vector_search_batch(
    vectors: DataFrame, queries: DataFrame, k: int = 10, vector: str = "vector", key: str = "id",
    query_key: str = "query_id", max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Exact top-k for many queries in one pass over the vectors.

    A query matrix within the size limit goes to every task, which scores its rows block by
    block with matrix products and keeps its own top-k per query (``Best``); only those rows shuffle.
    A larger query set takes the cell index with the exact finish instead. Text and metadata
    of the hits are a join on the key afterwards, so they are not carried through the scan.
    """
    known = _query_matrix(queries, query_key, vector, max_broadcast_bytes)
    if known is None:
        index = build_cells(vectors, vector=vector, key=key)
        return search_cells(index, queries, k, query_key=query_key, vector=vector, exact=True)
    query_ids, matrix = known
    targets = _unit(matrix)
    shared = vectors.sparkSession.sparkContext.broadcast((np.array(query_ids, dtype=object), targets))

    def score(batches):
        ids, unit = shared.value
        codes, names = pd.factorize(ids)  # a null query id gets -1 and no hits
        asked = np.flatnonzero((codes >= 0) & ~np.isnan(unit).any(axis=1))
        best = Best(np.full(len(names), -np.inf), k)
        for batch in batches:
            if not len(batch) or not len(asked):
                continue
            rows_unit = _unit(_stack(batch[vector]))
            whole = ~np.isnan(rows_unit).any(axis=1)
            keys, rows_unit = batch[key].to_numpy()[whole], rows_unit[whole]
            tile = max(1, SCORE_BLOCK_BYTES // (8 * max(1, len(keys))))
            for first in range(0, len(asked), tile):
                q = asked[first:first + tile]
                best.offer(codes[q], keys, unit[q] @ rows_unit.T)
        yield from best.frames(names, query_key, key)

    out = T.StructType([
        T.StructField(query_key, queries.schema[query_key].dataType), vectors.schema[key],
        T.StructField("score", T.DoubleType())])
    partial = vectors.select(vector, key).filter(F.col(vector).isNotNull()).mapInPandas(score, out)
    return _rank(partial, k, query_key, key)


def _rank(hits: DataFrame, k: int, query_key: str, key: str) -> DataFrame:
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), F.asc(key))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


@dataclass(frozen=True)
class CellIndex:
    """Unit vectors with their cell, and one centre and radius per (cell, part)."""

    rows: DataFrame
    centres: np.ndarray
    cells: DataFrame
    key: str


def build_cells(
    vectors: DataFrame, n_cells: int | None = None, vector: str = "vector", key: str = "id", seed: int = 7,
    rows_per_part: int = 100_000,
) -> CellIndex:
    """Assign every vector to its nearest k-means centre.

    Centres are fitted on all vectors; their number is the root of the number of vectors
    within the bounds of ``CELLS`` unless it is given. A cell above ``rows_per_part`` is split into parts by a hash
    of the key, so one crowded cell is many tasks. Write ``rows`` partitioned by ``cell`` to
    keep the index; a probe of few cells then prunes the other folders.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    unit = vectors.withColumn("_unit", l2_normalize(F.col(vector))).filter(_has_direction(F.col(vector)))
    n_cells = n_cells or int(min(max(unit.count() ** 0.5, CELLS[0]), CELLS[1]))
    model = KMeans(k=n_cells, seed=seed, maxIter=10, featuresCol="_f").fit(
        unit.select(array_to_vector("_unit").alias("_f")))
    centres = np.array(model.clusterCenters())
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def assign(batches):
        c = shared.value
        for batch in batches:
            if len(batch):
                m = _stack(batch["_unit"])
                far = (m * m).sum(1)[:, None] - 2 * m @ c.T + (c * c).sum(1)[None, :]
                cell = far.argmin(1)
                gap = np.sqrt(np.maximum(far[np.arange(len(m)), cell], 0))
                yield batch.assign(cell=cell.astype("int32"), gap=gap)

    slim = unit.select(key, "_unit")
    rows = slim.mapInPandas(assign, T.StructType(
        [*slim.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("gap", T.DoubleType())]))
    # the assignment is read for the sizes and by every search; keep it instead of making it again
    checkpoint_dir(vectors.sparkSession)
    rows = rows.checkpoint()
    sizes = rows.groupBy("cell").agg(F.count("*").alias("n"))
    parts = sizes.select("cell", F.greatest(F.lit(1), F.ceil(F.col("n") / rows_per_part)).cast("int").alias("parts"))
    # one row per cell, CELLS[1] at most unless the caller asks for more
    rows = rows.join(F.broadcast(parts), "cell").withColumn(
        "part", F.pmod(F.xxhash64(key), F.col("parts").cast("long")).cast("int"))
    rows = rows.drop("parts")
    cells = rows.groupBy("cell", "part").agg(F.max("gap").alias("radius"), F.count("*").alias("n"))
    return CellIndex(rows, centres, cells, key)


def _has_direction(vector: Column) -> Column:
    return (norm(vector) > 0) & ~F.isnan(norm(vector))


def _probes(index: CellIndex, asked: DataFrame, nprobe: int, beyond: bool = False) -> DataFrame:
    """(query, cell) for the ``nprobe`` nearest cells; or, ``beyond`` them, for the cells within the query's ``_reach``.

    Cells are chosen where distances are made, so no row is written for a cell that is not probed.
    """
    furthest = {r["cell"]: r["radius"] for r in index.cells.groupBy("cell").agg(F.max("radius").alias("radius")).collect()}
    radius = np.array([furthest.get(c, -np.inf) for c in range(len(index.centres))])
    shared = asked.sparkSession.sparkContext.broadcast((index.centres, radius))

    def choose(batches):
        c, r = shared.value
        for batch in batches:
            if not len(batch):
                continue
            m = _stack(batch["_target"])
            far = np.sqrt(np.maximum((m * m).sum(1)[:, None] - 2 * m @ c.T + (c * c).sum(1)[None, :], 0))
            near = far.argsort(1, kind="stable").argsort(1, kind="stable")
            chosen = near < nprobe
            if beyond:
                chosen = ~chosen & (far - r <= batch["_reach"].to_numpy()[:, None])
            row, cell = np.nonzero(chosen)
            out = batch.drop(columns="_reach", errors="ignore").iloc[row].reset_index(drop=True)
            yield out.assign(cell=cell.astype("int32"), far=far[row, cell])

    kept = [f for f in asked.schema.fields if f.name != "_reach"]
    return asked.mapInPandas(choose, T.StructType([*kept, T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())]))


def search_cells(
    index: CellIndex, queries: DataFrame, k: int = 10, nprobe: int = 4, query_key: str = "query_id",
    vector: str = "vector", exact: bool = False,
) -> DataFrame:
    """Top-k from the ``nprobe`` nearest cells; ``exact`` then checks every cell that may hold better.

    On unit vectors cosine falls as distance grows, so the k-th best distance found so far
    bounds the search: a cell whose centre is further away than that bound plus its radius
    cannot hold a better row. Queries meet vectors by an equi-join on (cell, part) only.
    """
    key = index.key
    asked = queries.filter(_has_direction(F.col(vector))).select(query_key, l2_normalize(F.col(vector)).alias("_target"))
    parts = index.cells.select("cell", "part", "radius")

    def hits(chosen: DataFrame) -> DataFrame:
        targets = chosen.select(query_key, "_target", "cell", "part")
        joined = targets.join(index.rows.select("cell", "part", key, "_unit"), ["cell", "part"])
        score = F.round(cosine_similarity(F.col("_target"), F.col("_unit")), SCORE_DIGITS)
        # a top-k per (query, cell, part) first: the final ranking gets few rows per query
        local = Window.partitionBy(query_key, "cell", "part").orderBy(F.desc("score"), F.asc(key))
        return (
            joined.select(query_key, "cell", "part", key, score.alias("score")).filter(_scored())
            .withColumn("_r", F.row_number().over(local)).filter(F.col("_r") <= k)
            .select(query_key, key, "score")
        )

    first = _rank(hits(_probes(index, asked, nprobe).join(parts, "cell")), k, query_key, key)
    if not exact:
        return first
    worst = first.groupBy(query_key).agg(F.count("*").alias("_n"), F.min("score").alias("_s"))
    # distance of unit vectors from their cosine, widened by the rounding of the score
    reach = F.when(F.col("_n") >= k, F.sqrt(F.greatest(2 - 2 * (F.col("_s") - 2e-9), F.lit(0.0))) + 1e-9)
    bounded = asked.join(worst, query_key, "left").select(query_key, "_target", F.coalesce(reach, F.lit(float("inf"))).alias("_reach"))
    rest = _probes(index, bounded, nprobe, beyond=True).join(parts, "cell").join(bounded.select(query_key, "_reach"), query_key)
    rest = rest.filter(F.col("far") - F.col("radius") <= F.col("_reach"))
    merged = first.select(query_key, key, "score").unionByName(hits(rest))
    return _rank(merged, k, query_key, key)


def recall_at_k(found: DataFrame, exact: DataFrame, k: int, query_key: str = "query_id", key: str = "id") -> DataFrame:
    """Share of the exact top-k an index found, per query."""
    hit = found.select(query_key, key).withColumn("_hit", F.lit(1))
    return exact.join(hit, [query_key, key], "left").groupBy(query_key).agg(
        (F.sum(F.coalesce("_hit", F.lit(0))) / F.count("*")).alias("recall"))


def retrieve_contexts(hits: DataFrame, texts: DataFrame, query_key: str = "query_id", key: str = "id") -> DataFrame:
    """The hit texts per query in rank order; at most k per query, so the list is short."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", "text")))
    return hits.join(texts.select(key, "text"), key).groupBy(query_key).agg(
        F.transform(ordered, lambda h: h["text"]).alias("contexts"))
