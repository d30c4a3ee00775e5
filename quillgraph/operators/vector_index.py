"""A stored vector index: cells with a centre and a radius, read cell by cell, exact by the triangle inequality.

Centres are fitted on a bounded sample; every row then goes to the cell of its nearest centre and is stored there with its distance, so
that nothing of the corpus is left out. No row of a cell is nearer to a query than (distance of the centre) - (radius).
A search reads the cells nearest to each query until they hold ``k`` rows, takes the distance of the k-th, and
then reads only the cells, and compares only the rows, that can hold a nearer one. Cosine is searched as distance of unit
vectors, which orders alike.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import vector as V
from . import retrieval as R

#: Vectors that centres are fitted on: the rows of least hash. Every row is indexed.
SAMPLE = 8192
ROUNDS = 12
#: Rows that one file of a cell holds about; a larger cell is split over tasks and files.
FILE_ROWS = 1_000_000


def _centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Lloyd's rounds from centres far from each other; the outcome depends on the sample alone."""
    centres = [sample[0]]
    near = ((sample - centres[0]) ** 2).sum(1)
    while len(centres) < min(cells, len(sample)) and near.max() > 0:
        centres.append(sample[int(np.argmax(near))])
        near = np.minimum(near, ((sample - centres[-1]) ** 2).sum(1))
    found = np.array(centres)
    for _ in range(ROUNDS):
        own = np.argmin(_squares(sample, found), axis=1)
        n = np.bincount(own, minlength=len(found))
        sums = np.zeros_like(found)
        np.add.at(sums, own, sample)
        found = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], found)
    return found


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None], 0)


def build(corpus: DataFrame, path: str, metric: str = "cosine", cells: int | None = None, sample: int = SAMPLE) -> None:
    """corpus(id, vector, payload) -> path/rows by cell, and path/cells with centre, radius and rows of each cell.

    Metrics: cosine and euclid. ``cells`` defaults to the square root of the rows, a quarter of the sample at most. The width is the sample's
    commonest; vectors without a score by ``knn`` and those of another width stand in the cell -1, which is always read.
    """
    if V.name_of(metric) not in ("cosine", "euclid"):
        raise ValueError("an index of cells needs a distance: cosine or euclid")
    metric = V.name_of(metric)
    spark = corpus.sparkSession
    rows = corpus.withColumn("vector", F.col("vector").cast("array<double>")).where("vector is not null and size(vector) > 0")
    total = rows.count()
    bound = min(2**63 - 1, -(2**63) + int(1.3 * sample / max(total, 1) * 2**64))  # little more than the sample is sorted
    hashed = rows.select(F.xxhash64("id", "vector").alias("h"), "id", "vector").where(F.col("h") <= bound).orderBy("h", "id").limit(sample).toArrow()
    found = sorted(R.matrices(hashed.column("id").combine_chunks(), hashed.column("vector")), key=lambda x: (-len(x[1]), x[1].shape[1]))
    width, centres = 0, np.zeros((0, 0))
    if found:
        v, sound = V.prepared(found[0][1], metric)
        if sound.any():
            width = v.shape[1]
            centres = _centres(v[sound], cells or max(1, min(sample // 4, int(total**0.5))))
    held = spark.sparkContext.broadcast((width, centres))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, centres = held.value
        for batch in batches:
            vectors = batch.column("vector")
            cell, away = np.full(len(vectors), -1), np.full(len(vectors), np.nan)
            for places, v in R.matrices(pa.array(np.arange(len(vectors))), vectors):
                if v.shape[1] != width or not width:
                    continue
                v, sound = V.prepared(v, metric)
                places, v = places.to_numpy()[sound], v[sound]
                cell[places] = own = np.argmin(_squares(v, centres), axis=1)
                away[places] = np.sqrt(((v - centres[own]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(away), pa.array(cell, pa.int32())], names=[*batch.schema.names, "away", "cell"])

    placed = rows.mapInArrow(place, f"{kinds}, away double, cell int")
    pieces = max(1, -(-total // (FILE_ROWS * max(1, len(centres)))))
    dealt = placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(pieces)))
    dealt.sortWithinPartitions("cell", "away").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    spark.createDataFrame([(json.dumps({"metric": metric, "width": width, "rows": dealt.schema.jsonValue()}),)], "told string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
    stored = read_rows(spark, path)
    told = stored.where("cell >= 0").groupBy("cell").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n"))
    named = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cell int, centre array<double>")
    named.join(told, "cell").withColumns({"metric": F.lit(metric)}).coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")  # a quarter of the sample at most


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """Every indexed row: the corpus's columns, away (the distance from its centre) and cell."""
    return spark.read.schema(StructType.fromJson(_about(spark, path)["rows"])).parquet(f"{path}/rows")


def _about(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.parquet(f"{path}/about").first().told)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, threshold: float | None = None, filters: dict | None = None) -> DataFrame:
    """queries(query_id, query_vector) -> query_id, id, score, rank: what ``knn`` gives, from the cells that can hold it.

    With ``filters`` the rows of a cell that pass aren't known beforehand, so the first round may find fewer than ``k``; then all
    cells within the threshold are read.
    """
    return R.best_of(reduce(DataFrame.unionByName, [_block(spark, path, block, k, threshold, filters)[0] for block in R.blocks_of(queries)]), k)


def cells_read(spark: SparkSession, path: str, queries: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    """query_id, cells and rows read, of how many: what the index saves."""
    cells = spark.read.parquet(f"{path}/cells").agg(F.count(F.lit(1)).alias("of_cells"), F.sum("n").alias("of_rows"))
    pairs = reduce(DataFrame.unionByName, [_block(spark, path, block, k, threshold, None)[1] for block in R.blocks_of(queries)])
    return pairs.join(F.broadcast(cells), F.lit(True))  # one row


def _block(spark: SparkSession, path: str, asked: DataFrame, k: int, threshold: float | None, filters: dict | None) -> tuple[DataFrame, DataFrame]:
    about = _about(spark, path)
    metric, width = about["metric"], about["width"]
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").toArrow()
    number, radius, n = (cells.column(c).to_numpy() for c in ("cell", "radius", "n"))
    centres = np.array(cells.column("centre").to_pylist(), float).reshape(len(number), width)
    rows = read_rows(spark, path)
    if filters:
        rows = rows.where(R.payload_filter(rows.columns, filters))
    other = asked.where(F.size("query_vector") != width) if width else asked
    rest = R._by_matrix(rows.where("cell = -1").select("id", "vector"), other, threshold, metric, k)
    table = asked.toArrow()  # a block
    own = [x for x in R.matrices(table.column("query_id").combine_chunks(), table.column("query_vector")) if x[1].shape[1] == width]
    kind, id_kind = asked.schema["query_id"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()
    told = f"query_id {kind}, cells bigint, rows bigint"
    if not own or not len(number):
        return rest, spark.createDataFrame([], told)
    names, q = own[0]
    q, sound = V.prepared(q, metric)
    names, q = names.filter(pa.array(sound)), q[sound]
    away = np.sqrt(_squares(q, centres))
    order = np.argsort(away, axis=1, kind="stable")
    first = np.zeros(away.shape, bool)
    before = np.cumsum(n[order], axis=1) - n[order]
    np.put_along_axis(first, order, before < k, axis=1)
    most = np.inf if threshold is None else np.sqrt(max(0.0, 2 - 2 * threshold)) if metric == "cosine" else max(0.0, -threshold)
    near = np.full(len(q), most)

    def read(wanted: np.ndarray, near: np.ndarray) -> DataFrame:
        """Pairs of queries with the rows of their wanted cells; rows too far from the centre to be near enough are skipped."""
        keep = {int(number[c]): np.flatnonzero(wanted[:, c]) for c in np.flatnonzero(wanted.any(axis=0))}
        held = spark.sparkContext.broadcast((names, q, away, near, keep, {int(c): i for i, c in enumerate(number)}))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q, away, near, keep, place = held.value
            for batch in batches:
                cell = batch.column("cell").to_numpy(zero_copy_only=False)
                for c in np.unique(cell):
                    mine = batch.filter(pa.array(cell == c))
                    far, asks = mine.column("away").to_numpy(), keep[int(c)]
                    # |d(query, centre) - d(row, centre)| is no more than d(query, row)
                    low = (away[asks, place[int(c)]] - near[asks]).min() - 1e-6
                    high = (away[asks, place[int(c)]] + near[asks]).max() + 1e-6
                    mine = mine.filter(pa.array((far >= low) & (far <= high)))
                    for ids, v in R.matrices(mine.column("id"), mine.column("vector")):
                        for x, y, scores, keys in R.best_pairs(V.prepared(v, metric)[0], ids, q[asks], metric, threshold, k):
                            yield pa.RecordBatch.from_arrays([names.take(pa.array(asks[y])), ids.take(pa.array(x)), pa.array(scores), pa.array(keys)], names=["query_id", "id", "score", "key"])

        return rows.where(F.col("cell").isin(list(keep))).select("id", "vector", "away", "cell").mapInArrow(run, f"query_id {kind}, id {id_kind}, score double, key double")

    begun = R.best_of(read(first, np.full(len(q), np.inf)), k)
    last = begun.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).toArrow()  # a row a query of the block
    place = {x: i for i, x in enumerate(names.to_pylist())}
    for name, found, least in zip(last.column("query_id").to_pylist(), last.column("n").to_pylist(), last.column("least").to_pylist()):
        if found >= k:  # scores are compared by six digits: a tie may stand a little farther off
            least -= 1e-6
            near[place[name]] = min(most, np.sqrt(max(0.0, 2 - 2 * least)) if metric == "cosine" else -least)
    wanted = (away - radius[None] <= near[:, None] + 1e-6) | first
    counts = spark.createDataFrame(list(zip(names.to_pylist(), wanted.sum(axis=1).tolist(), (wanted * n[None]).sum(axis=1).tolist())), told)
    return read(wanted, near).unionByName(rest), counts
