"""A stored inverted file of vectors that grows batch by batch.

Cells are the Voronoi cells of centers fitted on a bounded sample; a cell's vectors, with the fields that whoever finds them
needs, are a folder of their own. A batch assigns its vectors to the centers there are and adds files; a search reads the
folders of the cells that its queries visit, and nothing is fitted or scanned again. When the file has grown GROWTH times
since its centers were fitted, a new generation is made of it, so refits cost a constant share of all work, and the number of
cells that a search visits is measured anew, as for `similar_incidents_ivf`.

A batch that runs again reads what was there before it and overwrites its own files.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.sampling import smallest_hashes
from faultline.operators import similarity as sm
from faultline.session import delete, exists, folders

GROWTH = 4
SAMPLE_VALUES = 8_000_000  # numbers of the sample that centers are fitted on
CENTERS = "cell int, center array<double>, probes int, fitted bigint"


class InvertedFile:
    def __init__(
        self, spark: SparkSession, root: str, fields: Sequence[str] = (), per_cell: int = sm.PER_CELL, k: int = 3, target: float = sm.TARGET
    ):
        self.spark, self.root, self.fields = spark, root, list(fields)
        self.per_cell, self.k, self.target = per_cell, k, target

    def _generations(self, before: int) -> list[int]:
        """Whole generations made before a batch; their centers are written last."""
        found = [int(n.split("=")[1]) for n in folders(self.spark, self.root) if n.startswith("generation=")]
        return sorted(g for g in found if g < before and exists(self.spark, f"{self.root}/generation={g}/centers/_SUCCESS"))

    def _lists(self, generation: int) -> str:
        return f"{self.root}/generation={generation}/lists"

    def read(self, generation: int, before: int) -> DataFrame:
        """record_id, embedding, fields and cell of what the batches before one have added."""
        return self.spark.read.parquet(self._lists(generation)).where(F.col("batch_id") < before).drop("batch_id")

    def _centers(self, generation: int) -> tuple[np.ndarray, int, int]:
        rows = self.spark.read.schema(CENTERS).parquet(f"{self.root}/generation={generation}/centers").orderBy("cell").collect()
        return np.array([r.center for r in rows]), rows[0].probes, rows[0].fitted

    def _assigned(self, vectors: DataFrame, centers: np.ndarray) -> DataFrame:
        kept = vectors.select("record_id", F.col("embedding").cast("array<float>").alias("embedding"), *self.fields)

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    yield batch.assign(cell=sm._nearest_center(batch["embedding"], centers))

        schema = ", ".join(f"`{n}` {t}" for n, t in kept.dtypes)
        return kept.mapInPandas(assign, f"{schema}, cell int")

    def _write(self, rows: DataFrame, generation: int, batch_id: int) -> None:
        # one task per cell writes it, however the rows came
        rows.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{self._lists(generation)}/batch_id={batch_id}")

    def _fit(self, vectors: DataFrame, total: int, batch_id: int) -> None:
        """A new generation of all vectors."""
        width = vectors.select(F.max(F.size("embedding"))).first()[0]
        sampled = min(sm.CENTER_SAMPLE, max(sm.PROBE_SAMPLE, SAMPLE_VALUES // width))
        sample = smallest_hashes(vectors.select("record_id", "embedding"), "record_id", sampled, total).toPandas()
        cells = min(sm.MOST_CELLS, max(1, round(total / self.per_cell)))
        centers = sm._centers(sm._unit(sm._matrix(sample["embedding"])), cells)
        self._write(self._assigned(vectors, centers), batch_id, batch_id)
        placed = self.read(batch_id, batch_id + 1).select("embedding", "cell")
        probes = sm._probes(placed, list(sample[: sm.PROBE_SAMPLE].itertuples()), centers, self.k, self.target)
        rows = [(i, [float(x) for x in c], probes, total) for i, c in enumerate(centers)]
        path = f"{self.root}/generation={batch_id}/centers"
        self.spark.createDataFrame(rows, CENTERS).coalesce(1).write.mode("overwrite").parquet(path)

    def extend(self, vectors: DataFrame, batch_id: int) -> None:
        """Add the vectors (record_id, embedding, fields) of a batch; rows without a vector, or with a zero one, are left out."""
        some = F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0)
        vectors = vectors.where(some)
        known = self._generations(batch_id)
        if not known:
            total = vectors.count()
            if total:
                self._fit(vectors, total, batch_id)
            return
        centers, _, fitted = self._centers(known[-1])
        self._write(self._assigned(vectors, centers), known[-1], batch_id)
        held = self.read(known[-1], batch_id + 1)
        total = held.count()
        if total > GROWTH * fitted:
            self._fit(held.drop("cell"), total, batch_id)
        for old in known[:-1]:
            delete(self.spark, f"{self.root}/generation={old}")

    def search(self, queries: DataFrame, before: int, block_values: int = sm.BLOCK_VALUES) -> DataFrame | None:
        """queries (query_id, embedding) -> query_id, rank, record_id, distance, similarity and the fields of the neighbours,
        among what the batches before one have added; None while there is nothing."""
        known = self._generations(before)
        if not known:
            return None
        centers, probes, _ = self._centers(known[-1])
        asked = sm._with_vector(queries, "query_id").withColumn("embedding", F.col("embedding").cast("array<float>"))
        distinct = sm._distinct(asked)
        every = sm.nearest_cells(list(range(len(centers))), probes)

        def visited(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            some = np.zeros(len(centers), dtype=bool)
            for batch in batches:
                for _, far in sm._center_strips(batch["embedding"], centers):
                    some |= every(far).any(axis=0)
            yield pd.DataFrame({"cell": np.flatnonzero(some)})

        # the folders of all other cells are not read; there are at most MOST_CELLS
        cells = [r[0] for r in distinct.select("embedding").mapInPandas(visited, "cell int").distinct().collect()]
        lists = self.read(known[-1], before).where(F.col("cell").isin(cells))
        sizes = {r["cell"]: r["count"] for r in lists.groupBy("cell").count().collect()}
        if sizes:
            stored = lists.select("record_id", "embedding", "cell")
            found = sm._cell_search(distinct, stored, sizes, centers, sm.nearest_cells(list(sizes), probes), self.k + 1, block_values)
        else:
            found = sm._no_rows(distinct, lists)
        near = sm._per_query(asked, distinct, found, self.k)
        return near.join(lists.select("record_id", *self.fields), "record_id") if self.fields else near
