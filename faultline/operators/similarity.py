"""Nearest past incidents by cosine distance.

Exact search prunes with pivots: each corpus vector belongs to its nearest pivot, and a query visits only
the cells that the triangle inequality cannot rule out (unit vectors, where cosine order is distance
order). Cells are packed into blocks of bounded size; a query goes once to each block that holds a cell it
visits, and a task multiplies one block of queries with one block of corpus vectors and gives back at most
k rows per query, so neither pairs nor visits become rows. Where vectors have no structure nothing is ruled
out; the inverted file then is the way for large corpora: it visits as many of the nearest cells as a
measured share of the true neighbours asks for, and if it is to be exact, the other cells that may hold a
nearer vector than those found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.numeric import percent_text, round_half_even
from faultline.functions.sampling import smallest_hashes
from faultline.functions.text import fill
from faultline.session import stable

PIVOTS = 32
BLOCK_VALUES = 4_000_000  # numbers in one block of vectors: 16 MB as floats
STRIP = 1024  # queries of a block that are compared at a time, with as many as
COLUMNS = 2048  # corpus vectors
AT_HAND = 1_000_000  # distances to centers at hand at a time
HITS = 32_768  # pairs compared in full at a time
PER_CELL = 2048  # vectors in a cell of the inverted file
MOST_CELLS = 4096
CENTER_SAMPLE = 32_768  # vectors that the centers are fitted on
PROBE_SAMPLE = 256  # vectors whose true neighbours say how many cells a query visits
TARGET = 0.98  # share of these neighbours that lie in visited cells
PER_BUCKET = 256  # vectors in a bucket of the hashed search
DIGITS = 12  # distances closer than this are equal, and go by id
TIE = 1e-11  # more than that
BROADCAST_CELLS = 100_000


# --- distances ----------------------------------------------------------------------------------
def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - a.b / (|a| |b|); null where a vector is all zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.lit(1.0) - dot(a, b) / F.nullif(norms, F.lit(0.0))


def similarity(distance: Column) -> Column:
    return round_half_even(F.greatest(F.lit(0.0), F.lit(1.0) - distance / 2), 3)


def _matrix(vectors: pd.Series, kind: type = np.float64) -> np.ndarray:
    return np.vstack([np.asarray(v, dtype=kind) for v in vectors])


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _to_pivots(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (units @ pivots.T)))


def _center_strips(vectors: pd.Series, centers: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Distances to the centers, for as many vectors at a time as are at hand."""
    step = max(64, AT_HAND // max(1, len(centers)))
    for lo in range(0, len(vectors), step):
        part = slice(lo, lo + step)
        yield part, _to_pivots(_unit(_matrix(vectors.iloc[part])), centers)


def _nearest_center(vectors: pd.Series, centers: np.ndarray) -> np.ndarray:
    return _cell_and_radius(vectors, centers)[0]


def _cell_and_radius(vectors: pd.Series, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest center, and how far it is."""
    near = [(far.argmin(axis=1), far.min(axis=1)) for _, far in _center_strips(vectors, centers)]
    return tuple(np.concatenate(x) for x in zip(*near, strict=True))


def _nearest_pairs(
    asked: np.ndarray, stored: np.ndarray, spans: list[tuple[int, int]], wanted: np.ndarray, rank: np.ndarray, k: int, twice: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of `asked`, row of `stored` and distance of the k nearest rows of `stored` in the wanted spans; equal distances go by `rank`.

    `wanted` says per row of `asked` and span whether it is searched. Products of floats rule out what cannot be among the k
    nearest found so far, by the bound of their error; the rest is compared in doubles. With `twice`, the k nearest are taken
    per span, as records that stand there twice take two places in their span only.
    """
    a_norm = np.sqrt(np.einsum("ij,ij->i", asked, asked, dtype=np.float64))
    b_norm = np.sqrt(np.einsum("ij,ij->i", stored, stored, dtype=np.float64))
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        a_unit = (asked / a_norm[:, None]).astype(np.float32)
        b_unit = (stored / b_norm[:, None]).astype(np.float32)
    # what is no direction is nobody's neighbour
    a_odd, b_odd = (~np.isfinite(u).all(axis=1) for u in (a_unit, b_unit))
    a_unit[a_odd], b_unit[b_odd] = 0, 0
    error = (asked.shape[1] + 4) * 2.0**-23
    found = []
    for lo in range(0, len(asked), STRIP):
        size = min(STRIP, len(asked) - lo)
        distance, place = np.full((size, k), np.inf), np.full((size, k), -1)
        for i, (first, last) in enumerate(spans):
            rows = np.flatnonzero(wanted[lo : lo + size, i] & ~a_odd[lo : lo + size])
            for left in range(first, last if len(rows) else first, COLUMNS):
                part = slice(left, min(last, left + COLUMNS))
                near = a_unit[lo + rows] @ b_unit[part].T
                if b_odd[part].any():
                    near[:, b_odd[part]] = -2
                least = 1.0 - distance[rows, -1] - error - TIE
                new = np.isinf(least)
                if new.any() and near.shape[1] > k:
                    at = near.shape[1] - k
                    least[new] = np.partition(near[new], at, axis=1)[:, at] - 2 * error - TIE
                hits = np.flatnonzero(near >= np.maximum(least, -1.5).astype(np.float32)[:, None])
                hit, column = np.divmod(hits, near.shape[1])
                if len(hit):
                    column += left
                    _keep(distance, place, rows[hit], column, _distances(asked, stored, a_norm, b_norm, lo + rows[hit], column), rank, k)
            if twice and len(rows):
                found.append(_taken(lo, distance, place))
                distance, place = np.full((size, k), np.inf), np.full((size, k), -1)
        found.append(_taken(lo, distance, place))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _distances(asked, stored, a_norm, b_norm, rows, columns) -> np.ndarray:
    """Distances of pairs in doubles; equal ones are equal to `DIGITS` digits."""
    dots = [
        np.einsum("ij,ij->i", asked[rows[i : i + HITS]].astype(np.float64), stored[columns[i : i + HITS]].astype(np.float64))
        for i in range(0, len(rows), HITS)
    ]
    return np.round(1.0 - np.concatenate(dots) / (a_norm[rows] * b_norm[columns]), DIGITS)


def _keep(distance, place, rows, columns, values, rank, k) -> None:
    """Puts pairs among the k nearest of their rows."""
    touched = np.unique(rows)
    rows = np.concatenate([np.repeat(touched, k), rows])
    columns = np.concatenate([place[touched].ravel(), columns])
    values = np.concatenate([distance[touched].ravel(), values])
    order = np.lexsort((rank[columns], values, rows))
    rows, columns, values = rows[order], columns[order], values[order]
    at = np.arange(len(rows)) - np.searchsorted(rows, rows, "left")
    best = at < k
    distance[rows[best], at[best]] = values[best]
    place[rows[best], at[best]] = columns[best]


def _taken(lo: int, distance: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, at = np.nonzero(place >= 0)
    return lo + rows, place[rows, at], distance[rows, at]


# --- exact search -------------------------------------------------------------------------------
def similar_incidents(
    queries: DataFrame, corpus: DataFrame, k: int = 3, pivots: int = PIVOTS, block_values: int = BLOCK_VALUES
) -> DataFrame:
    """queries (query_id, embedding), corpus (record_id, embedding) -> query_id, rank, record_id, distance, similarity.

    Rows without a vector, or with a zero vector, are skipped, and a query is not its own neighbour. The
    corpus holds what was stored before the queries came. Copies of a vector are searched once, and only
    the lowest k + 1 ids of a vector can be among anybody's k nearest.
    """
    corpus = _lowest_ids(_with_vector(corpus, "record_id"), k + 1)
    asked = _with_vector(queries, "query_id")
    distinct = _distinct(asked)
    found = _exact(distinct.select("_q", "embedding"), corpus, k + 1, pivots, block_values)
    return _per_query(asked, distinct, found, k)


def _with_vector(df: DataFrame, key: str) -> DataFrame:
    some = F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0)
    return df.where(some).select(key, "embedding")


def _sound(df: DataFrame) -> DataFrame:
    """Rows whose vector is a direction; others are nobody's neighbour, and as centers they would be nearest to all."""
    return df.where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def _distinct(asked: DataFrame) -> DataFrame:
    return stable(asked.groupBy("embedding").agg(F.min("query_id").alias("_q")))


def _lowest_ids(corpus: DataFrame, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("embedding").orderBy("record_id"))
    return corpus.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def _per_query(asked: DataFrame, distinct: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Gives each query the neighbours of its vector, without itself: at most k + 1 per vector."""
    near = found.groupBy("_q").agg(F.sort_array(F.collect_list(F.struct("distance", "record_id"))).alias("near"))
    lists = distinct.join(near, "_q").select("embedding", "near")
    mine = asked.join(lists, "embedding").select(
        "query_id", F.slice(F.filter("near", lambda n: n["record_id"] != F.col("query_id")), 1, k).alias("near")
    )
    rows = mine.select("query_id", F.posexplode("near").alias("_at", "n"))
    return rows.select(
        "query_id",
        (F.col("_at") + 1).alias("rank"),
        "n.record_id",
        "n.distance",
        similarity(F.col("n.distance")).alias("similarity"),
    )


def _exact(queries: DataFrame, corpus: DataFrame, k: int, pivots: int, block_values: int) -> DataFrame:
    corpus = stable(corpus)
    chosen = corpus.orderBy(F.xxhash64("record_id"), "record_id").limit(pivots).collect()  # `pivots` vectors
    if not chosen:
        return _no_rows(queries, corpus)
    centers = _unit(_matrix(pd.Series([r.embedding for r in chosen])))
    id_type = corpus.schema["record_id"].dataType.simpleString()

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                far = _to_pivots(_unit(_matrix(batch["embedding"])), centers)
                batch["cell"] = far.argmin(axis=1)
                batch["radius"] = far.min(axis=1)
                yield batch

    placed = stable(corpus.mapInPandas(assign, f"record_id {id_type}, embedding array<float>, cell int, radius double"))
    near = F.row_number().over(Window.partitionBy("cell").orderBy("radius", "record_id"))
    # pivots * k rows and pivots rows
    closest = placed.withColumn("_r", near).where(F.col("_r") <= k).select("cell", "radius").collect()
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("radius").alias("low"), F.max("radius").alias("high")).collect()
    inner = np.array([(r.cell, r.radius) for r in closest])
    cells = np.array([(r.cell, r.low, r.high) for r in sizes])
    ids = cells[:, 0].astype(int)
    between = _to_pivots(centers, centers)

    def visits(far: np.ndarray) -> np.ndarray:
        # k corpus vectors are surely within this distance
        upper = np.sort(far[:, inner[:, 0].astype(int)] + inner[:, 1], axis=1)
        upper = upper[:, k - 1] if upper.shape[1] >= k else np.full(len(far), np.inf)
        return _least_distance(far, ids, between, cells[:, 1], cells[:, 2]) <= upper[:, None] + 1e-6

    return _cell_search(queries, placed, {r.cell: r.n for r in sizes}, centers, visits, k, block_values)


def _no_rows(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    empty = queries.select("_q").limit(0).join(corpus.select("record_id").limit(0), F.lit(False))
    return empty.withColumn("distance", F.lit(0.0))


def _packed(sizes: list[int], most: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Cells into blocks of `most` vectors, in order: the first block and the number of blocks of each cell, and the cells of each block.

    A cell that is larger has blocks of its own.
    """
    first, parts, blocks, room = [], [], [], 0
    for at, n in enumerate(sizes):
        cut = -(-n // most)
        if cut == 1 and n <= room:
            blocks[-1] = (blocks[-1][0], at + 1)
            room -= n
        else:
            blocks += [(at, at + 1)] * cut
            room = most - n if cut == 1 else 0
        first.append(len(blocks) - cut)
        parts.append(cut)
    return np.array(first), np.array(parts), blocks


def _cell_search(
    queries: DataFrame, corpus: DataFrame, sizes: dict[int, int], centers: np.ndarray, visits: Callable[..., np.ndarray], k: int,
    block_values: int,
) -> DataFrame:
    """The k nearest corpus vectors (record_id, embedding, cell) per query (_q, embedding) among those in the cells it visits.

    `sizes` holds the number of vectors per cell, of which there are no more than centers; `visits` gives from the distances of queries
    to all centers, and from their `reach` if they have such a column, which of these cells, in their order, are visited. A query goes
    once to each block that holds such a cell, with a bit per cell. A cell that holds most vectors becomes many blocks.
    """
    spark, width, asked = queries.sparkSession, centers.shape[1], queries.count()
    ids = np.array(list(sizes))
    most = max(1, block_values // width)
    # near cells stand together, so that a query visits few blocks
    near = _centers(centers[ids], max(1, sum(sizes.values()) // most)) if len(ids) > 1 else centers[ids]
    order = np.lexsort((ids, (centers[ids] @ near.T).argmax(axis=1)))
    first, parts, blocks = _packed([sizes[i] for i in ids[order].tolist()], most)
    position = np.zeros(max(ids) + 1, dtype=np.int64)
    position[ids[order]] = np.arange(len(ids))
    tasks = 3 * spark.sparkContext.defaultParallelism
    q_parts = max(1, -(-asked // most), min(-(-tasks // len(blocks)), asked // STRIP))
    q_type, id_type = queries.schema["_q"].dataType.simpleString(), corpus.schema["record_id"].dataType.simpleString()

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, far in _center_strips(batch["embedding"], centers):
                some = batch.iloc[part]
                wanted = visits(far, *(some[c].to_numpy() for c in reach))[:, order]
                for block, (lo, hi) in enumerate(blocks):
                    rows = np.flatnonzero(wanted[:, lo:hi].any(axis=1))
                    if len(rows):
                        bits = [b.tobytes() for b in np.packbits(wanted[rows, lo:hi], axis=1)]
                        yield some.iloc[rows].drop(columns=reach).assign(block=block, visited=bits)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                at = position[batch["cell"].to_numpy()]
                yield batch.drop(columns="_h").assign(cell=at, block=first[at] + batch["_h"].to_numpy() % parts[at])

    reach = [c for c in ("reach",) if c in queries.columns]
    routed = queries.select("_q", "embedding", *reach).mapInPandas(route, f"_q {q_type}, embedding array<float>, block int, visited binary")
    routed = routed.withColumn("q_part", F.pmod(F.xxhash64("_q"), F.lit(q_parts)).cast("int"))
    dealt = corpus.select("record_id", "embedding", "cell", F.xxhash64("record_id").alias("_h"))
    dealt = dealt.mapInPandas(deal, f"record_id {id_type}, embedding array<float>, cell int, block int")
    dealt = dealt.withColumn("q_part", F.explode(F.sequence(F.lit(0), F.lit(q_parts - 1))))

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return _none_found(left, right)
        lo, hi = blocks[left["block"].iloc[0]]
        right = right.sort_values(["cell", "record_id"], kind="stable")
        cell = right["cell"].to_numpy()
        spans = [(int(np.searchsorted(cell, c)), int(np.searchsorted(cell, c, "right"))) for c in range(lo, hi)]
        bits = np.frombuffer(b"".join(left["visited"]), np.uint8).reshape(len(left), -1)
        return _found(left, right, spans, np.unpackbits(bits, axis=1, count=hi - lo).astype(bool), k)

    schema = f"_q {q_type}, record_id {id_type}, distance double"
    # few bytes are much work here, so the tasks are not put together by their size
    pair, dealt_to = ["block", "q_part"], min(MOST_CELLS, len(blocks) * q_parts)
    left, right = (side.repartition(dealt_to, *pair).groupBy(*pair) for side in (routed, dealt))
    local = left.cogroup(right).applyInPandas(nearest, schema)
    return _k_best(local, k)


def _none_found(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """No rows, of the types of the ids: what is empty without a type cannot become texts."""
    return pd.DataFrame({"_q": left["_q"][:0], "record_id": right["record_id"][:0], "distance": np.zeros(0)})


def _found(left: pd.DataFrame, right: pd.DataFrame, spans: list[tuple[int, int]], wanted: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest of `right` for the rows of `left`."""
    ids = right["record_id"]
    rank = np.empty(len(ids), dtype=np.int64)
    rank[ids.reset_index(drop=True).sort_values(kind="stable").index] = np.arange(len(ids))
    asked, stored = _matrix(left["embedding"], np.float32), _matrix(right["embedding"], np.float32)
    twice = len(spans) > 1 and bool(ids.duplicated().any())
    rows, columns, distance = _nearest_pairs(asked, stored, spans, wanted, rank, k, twice)
    return pd.DataFrame({"_q": left["_q"].to_numpy()[rows], "record_id": ids.to_numpy()[columns], "distance": distance})


def _k_best(local: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("_q").orderBy("distance", "record_id")
    # a vector may share several buckets with a query
    local = local.dropDuplicates(["_q", "record_id"])
    return local.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")


def _block_search(queries: DataFrame, corpus: DataFrame, k: int, block_values: int) -> DataFrame:
    """The k nearest corpus vectors per query among those that share a cell, cell by cell in blocks.

    The sizes of cells decide into how many blocks each side of a cell is cut, so a cell that holds most
    vectors becomes many tasks.
    """
    queries = stable(queries)
    q_type = queries.schema["_q"].dataType.simpleString()
    id_type = corpus.schema["record_id"].dataType.simpleString()
    width = F.max(F.size("embedding"))

    def parts(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy("cell").agg(F.ceil(F.count("*") * width / block_values).cast("int").alias(name))

    # what Spark guesses of the size of rows that Python makes is too little, so the small side is named
    cuts = stable(parts(queries, "q_parts").join(parts(corpus, "c_parts").hint("merge"), "cell"))
    cuts = F.broadcast(cuts) if cuts.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS else cuts.hint("merge")
    # each query goes to every corpus block of its cell, each corpus vector to every query block
    q = queries.join(cuts, "cell").select(
        "cell", "_q", "embedding", F.pmod(F.xxhash64("_q"), "q_parts").alias("q_part"),
        F.explode(F.sequence(F.lit(0), F.col("c_parts") - 1)).alias("c_part"),
    )
    c = corpus.join(cuts, "cell").select(
        "cell", "record_id", "embedding", F.pmod(F.xxhash64("record_id"), "c_parts").cast("int").alias("c_part"),
        F.explode(F.sequence(F.lit(0), F.col("q_parts") - 1)).alias("q_part"),
    )
    keys = ["cell", F.col("q_part").cast("bigint"), F.col("c_part").cast("bigint")]

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return _none_found(left, right)
        return _found(left, right, [(0, len(right))], np.ones((len(left), 1), dtype=bool), k)

    schema = f"_q {q_type}, record_id {id_type}, distance double"
    return _k_best(q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(nearest, schema), k)


# --- search in an inverted file -----------------------------------------------------------------
def similar_incidents_ivf(
    queries: DataFrame, corpus: DataFrame, k: int = 3, per_cell: int = PER_CELL, target: float = TARGET,
    block_values: int = BLOCK_VALUES, exact: bool = False,
) -> DataFrame:
    """As `similar_incidents`, among the corpus vectors in the cells nearest to each query.

    Cells grow with the corpus. How many of them a query visits is measured: a sample of corpus vectors is compared
    with every vector, and `target` of the neighbours found so must lie in visited cells. Vectors in groups need few
    cells, vectors without structure many. A corpus of one cell is searched whole. With `exact` the rows are those of
    `similar_incidents`: a query then goes to every other cell that may hold one nearer than its last neighbour.
    """
    corpus = stable(_lowest_ids(_sound(_with_vector(corpus, "record_id")), k + 1))
    asked = _sound(_with_vector(queries, "query_id"))
    distinct = _distinct(asked)
    total = corpus.count()
    if not total:
        return _per_query(asked, distinct, _no_rows(distinct, corpus), k)
    fitted = smallest_hashes(corpus, "record_id", CENTER_SAMPLE, total).toArrow().to_pandas()
    centers = _centers(_unit(_matrix(fitted["embedding"])), min(MOST_CELLS, max(1, round(total / per_cell))))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                cell, radius = _cell_and_radius(batch["embedding"], centers)
                yield batch.assign(cell=cell, radius=radius)

    id_type = corpus.schema["record_id"].dataType.simpleString()
    placed = stable(corpus.mapInPandas(assign, f"record_id {id_type}, embedding array<float>, cell int, radius double"))
    probes = _probes(placed, list(fitted[:PROBE_SAMPLE].itertuples()), centers, k, target)
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("radius").alias("low"), F.max("radius").alias("high"))
    cells = cells.collect()  # no more than MOST_CELLS
    sizes = {r.cell: r.n for r in cells}
    found = _cell_search(distinct, placed, sizes, centers, nearest_cells(list(sizes), probes), k + 1, block_values)
    if exact and probes < len(centers):
        found = stable(found)
        # as a length between unit vectors; where fewer than k + 1 are found, no distance is too far
        length = F.sqrt(2 * (F.greatest(F.max("distance"), F.lit(0.0)) + TIE))
        last = found.groupBy("_q").agg(F.when(F.count("*") > k, length).alias("reach"))
        asking = distinct.join(last, "_q", "left").select("_q", "embedding", F.coalesce("reach", F.lit(float("inf"))).alias("reach"))
        others = other_cells(list(sizes), probes, centers, np.array([r.low for r in cells]), np.array([r.high for r in cells]))
        found = _k_best(found.unionByName(_cell_search(asking, placed, sizes, centers, others, k + 1, block_values)), k + 1)
    return _per_query(asked, distinct, found, k)


def nearest_cells(cells: list[int], probes: int) -> Callable[[np.ndarray], np.ndarray]:
    """Which of `cells` are among the `probes` nearest, from the distances to all centers."""

    def visits(far: np.ndarray) -> np.ndarray:
        wanted = np.zeros(far.shape, dtype=bool)
        np.put_along_axis(wanted, np.argsort(far, axis=1, kind="stable")[:, :probes], True, axis=1)
        return wanted[:, cells]

    return visits


def other_cells(cells: list[int], probes: int, centers: np.ndarray, low: np.ndarray, high: np.ndarray) -> Callable[..., np.ndarray]:
    """Which of `cells`, without the `probes` nearest, may hold a vector within `reach` of a query.

    The vectors of a cell are `low` to `high` away from its center, and nearer to it than to the one nearest to the query.
    """
    near, between = nearest_cells(cells, probes), _to_pivots(centers, centers)

    def visits(far: np.ndarray, reach: np.ndarray) -> np.ndarray:
        return ~near(far) & (_least_distance(far, cells, between, low, high) <= reach[:, None] + 1e-6)

    return visits


def _least_distance(far: np.ndarray, cells: list[int] | np.ndarray, between: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """No vector of a cell is nearer to a query than this."""
    here = far[:, cells]
    gap = between[far.argmin(axis=1)][:, cells]
    plane = np.divide(here**2 - far.min(axis=1)[:, None] ** 2, 2 * gap, out=np.zeros_like(here), where=gap > 0)
    return np.maximum(np.maximum(here - high, low - here), plane)


def _centers(units: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Unit centers of a sample by spherical k-means; a center without vectors stays."""
    centers = units[np.random.default_rng(11).permutation(len(units))[:count]]
    for _ in range(rounds if len(centers) > 1 else 0):
        # a strip at a time, so the products stay small
        step = max(64, AT_HAND // len(centers))
        cell = np.concatenate([(units[i : i + step] @ centers.T).argmax(axis=1) for i in range(0, len(units), step)])
        sums = np.zeros_like(centers)
        np.add.at(sums, cell, units)
        moved = _unit(sums)
        centers = np.where(np.abs(moved).sum(axis=1, keepdims=True) > 0, moved, centers)
    return centers


def _probes(placed: DataFrame, sample: list, centers: np.ndarray, k: int, target: float) -> int:
    """Nearest cells to visit so that `target` of the sample's true neighbours are in one.

    Each task reports the k + 1 nearest of its vectors for every sampled one, as distance and cell.
    """
    if len(centers) == 1:
        return 1
    asked = _unit(_matrix(pd.Series([r.embedding for r in sample])))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        far, cell = np.full((len(asked), k + 1), np.inf), np.full((len(asked), k + 1), -1)
        for batch in batches:
            for lo in range(0, len(batch), COLUMNS):
                some = batch.iloc[lo : lo + COLUMNS]
                far = np.hstack([far, 1.0 - asked @ _unit(_matrix(some["embedding"])).T])
                cell = np.hstack([cell, np.broadcast_to(some["cell"].to_numpy(), (len(asked), len(some)))])
                best = np.argsort(far, axis=1, kind="stable")[:, : k + 1]
                far, cell = np.take_along_axis(far, best, 1), np.take_along_axis(cell, best, 1)
        at, place = np.nonzero(cell >= 0)
        yield pd.DataFrame({"at": at, "distance": far[at, place], "cell": cell[at, place]})

    local = placed.select("embedding", "cell").mapInPandas(nearest, "at int, distance double, cell int")
    rank = F.row_number().over(Window.partitionBy("at").orderBy("distance", "cell"))
    # the nearest of all is the sampled vector itself; at most k * PROBE_SAMPLE rows
    found = local.withColumn("_r", rank).where((F.col("_r") > 1) & (F.col("_r") <= k + 1)).select("at", "cell").collect()
    order = np.argsort(np.argsort(_to_pivots(asked, centers), axis=1, kind="stable"), axis=1, kind="stable")
    ranks = np.sort([order[r.at, r.cell] for r in found])
    return int(ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))))]) + 1 if len(ranks) else 1


# --- hashed search ------------------------------------------------------------------------------
def similar_incidents_lsh(
    queries: DataFrame, corpus: DataFrame, k: int = 3, tables: int = 8, bits: int | None = None, flips: int = 2, seed: int = 7,
    block_values: int = BLOCK_VALUES,
) -> DataFrame:
    """As `similar_incidents`, among the vectors that share a random-hyperplane bucket in some table.

    The bits of a bucket follow from the size of the corpus, about PER_BUCKET vectors each, unless given. A query
    also visits the buckets on the other side of its `flips` nearest planes, one at a time.
    """
    corpus = stable(_lowest_ids(_with_vector(corpus, "record_id"), k + 1))
    asked = _with_vector(queries, "query_id")
    distinct = _distinct(asked)
    depth = max(1, round(np.log2(max(1, corpus.count()) / PER_BUCKET))) if bits is None else bits

    def keyed(df: DataFrame, key: str, more: int) -> DataFrame:
        def buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            weights = 1 << np.arange(depth, dtype=np.int64)
            for batch in batches:
                if not len(batch):
                    continue
                matrix = _matrix(batch["embedding"])
                planes = np.random.default_rng(seed).standard_normal((tables, depth, matrix.shape[1]))
                for t in range(tables):
                    side = matrix @ planes[t].T
                    code = (t << depth) + (side >= 0) @ weights
                    yield batch.assign(cell=code)
                    close = np.argsort(np.abs(side), axis=1)[:, :more]
                    for column in close.T:
                        yield batch.assign(cell=code ^ weights[column])

        kind = df.schema[key].dataType.simpleString()
        return df.select(key, "embedding").mapInPandas(buckets, f"{key} {kind}, embedding array<float>, cell bigint")

    found = _block_search(keyed(distinct, "_q", flips), keyed(corpus, "record_id", 0), k + 1, block_values)
    return _per_query(asked, distinct, found, k)


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours that the approximate search found."""
    hit = exact.select("query_id", "record_id").join(
        approximate.select("query_id", "record_id", F.lit(1).alias("_hit")), ["query_id", "record_id"], "left"
    )
    return hit.agg(F.count("*").alias("expected"), F.count("_hit").alias("found"), (F.count("_hit") / F.count("*")).alias("recall"))


# --- what is done with neighbours -----------------------------------------------------------------
def with_records(neighbours: DataFrame, records: DataFrame) -> DataFrame:
    """Adds the stored evaluation of each neighbour."""
    return neighbours.join(records, "record_id")


def retrieval_context(found: DataFrame) -> DataFrame:
    """query_id -> the markdown block of its neighbours (at most k lines of them per query)."""
    from faultline import fixed

    def line(label: str, column: str) -> Column:
        text = F.coalesce(F.col(column), F.lit(""))
        return F.when(text != "", F.concat(F.lit(f"- **{label}:** "), text, F.lit("\n"))).otherwise("")

    block = F.concat(
        fill("### Incident {rank} (similarity: {percent})\n", rank=F.col("rank"), percent=percent_text(F.col("similarity"))),
        fill("- **Workflow:** {w}\n", w=F.col("workflow")),
        fill("- **Type / Severity:** {t} / {s}\n", t=F.col("incident_type"), s=F.col("severity")),
        fill("- **Evaluation:** {st} (score {sc})\n", st=F.col("status"), sc=F.col("score")),
        line("Summary", "summary"),
        line("Action taken", "suggested_action"),
    )
    gathered = found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", block.alias("b")))).alias("blocks"))
    return gathered.select(
        "query_id", F.concat(F.lit(fixed.CONTEXT_HEADER), F.array_join("blocks.b", "\n")).alias("context")
    )


def rag_evaluate(evaluated: DataFrame, contexts: DataFrame, key: str = "record_id") -> DataFrame:
    """Evaluations with the retrieved context after their reasoning."""
    # an incident may have a context of its own
    told = contexts.select(F.col("query_id").alias(key), F.col("context").alias("_context"))
    joined = evaluated.join(told, key, "left")
    used = F.col("_context").isNotNull()
    text = F.when(used, F.concat("reasoning", F.lit("\n\n"), "_context")).otherwise(F.col("reasoning"))
    return joined.withColumns({"reasoning": text, "context_used": used}).drop("_context")


def retrieval_outcome(queries: DataFrame, neighbours: DataFrame) -> DataFrame:
    """hit or miss by number of neighbours, and how many queries had it."""
    counts = neighbours.groupBy("query_id").agg(F.count("*").alias("found"))
    joined = queries.select("query_id").join(counts, "query_id", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    outcome = F.when(F.col("found") > 0, "hit").otherwise("miss")
    return joined.groupBy(outcome.alias("retrieval"), "found").agg(F.count("*").alias("queries"))


def neighbour_action_profile(found: DataFrame) -> DataFrame:
    """The most common action among a query's neighbours and its share; equal counts go by name."""
    counted = found.where(F.col("suggested_action").isNotNull()).groupBy("query_id", "suggested_action").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("suggested_action").alias("name")))
    totals = found.groupBy("query_id").agg(F.count("*").alias("neighbours"))
    top = counted.groupBy("query_id").agg(best.alias("best"))
    return totals.join(top, "query_id", "left").select(
        "query_id", F.col("best.name").alias("action"), F.coalesce(-F.col("best.n"), F.lit(0)).alias("cases"), "neighbours"
    )


def index_rows(records: DataFrame, text: Column) -> DataFrame:
    """record_id, text and the metadata kept beside a vector."""
    names = ("record_id", "workflow", "incident_type", "severity", "summary")
    pairs = [x for n in names for x in (F.lit(n), F.coalesce(F.col(n), F.lit("")))]
    return records.select("record_id", text.alias("text"), F.create_map(*pairs).alias("metadata"))


def store_embeddings(records: DataFrame, vectors: DataFrame) -> DataFrame:
    """Records with their vector where there is one; vectors of unknown records are dropped."""
    return records.join(vectors.select("record_id", "embedding"), "record_id", "left")
