"""Exact similarity joins and nearest neighbours of vectors over cells of pivots.

Every vector lives in the cell of its most similar pivot. A vector ``y`` of cell ``j`` is at least as near to pivot ``j``
as to the pivot ``i`` of a vector ``x``, so their distance is at least ``x``'s margin between the two pivots over the
pivots' distance; a vector only visits cells where that bound allows a partner. Cells of any size are dealt out as
pairs of blocks of at most about ``BLOCK`` rows, so no task holds a group, and nothing goes through the driver but the
pivots, whose number is bounded.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one side of a comparison, and pivots at most.
BLOCK = 2048
PIVOTS = 4096
#: Without cells: blocks of a side at most, rows of it that are compared at once, and the share of cells met from which cells are of little use.
SIDES, STRETCH, DENSE = 4, 256, 0.25
#: Rows of the sample that tells how many cells a row meets.
SAMPLE = 512
#: Rounding of unit vectors and their products.
_SLACK = 1e-9


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _units(vectors: DataFrame, vector: str, **columns: Column) -> DataFrame:
    """The columns and ``u``, the vector over its length; a vector of length 0 stays. Rows without a vector are left out."""
    v = F.col(vector).cast("array<double>")
    n = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    x = vectors.select(*[c.alias(n) for n, c in columns.items()], v.alias("v")).where(F.size("v") > 0).withColumn("n", n)
    return x.select(*columns, F.when(F.col("n") > 0, F.transform("v", lambda y: y / F.col("n"))).otherwise(F.col("v")).alias("u"), (F.col("n") > 0).alias("some"))


def _pivots(units: DataFrame, rows: int, key: str) -> np.ndarray:
    """About one pivot for every block of rows: those with the least hashes of their keys."""
    wanted = max(1, min(PIVOTS, rows // BLOCK))
    found = units.where("some").select(F.xxhash64(key).alias("h"), "u").orderBy("h", "u").limit(wanted).collect()
    return np.array([r["u"] for r in found], np.float64)


def _margins(u: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The home of each row, and the least distance of a row to what may live in each cell."""
    s = u @ pivots.T
    home = s.argmax(axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0.0))[home]
    with np.errstate(divide="ignore", invalid="ignore"):
        least = np.where(apart > 1e-6, (s[np.arange(len(s)), home][:, None] - s) / apart, 0.0)
    return home, least


def _cells(units: DataFrame, pivots: np.ndarray, radius: float | str | None, later: bool) -> DataFrame:
    """``units`` with ``cell`` and ``home``: a row at home, and, within a radius or the column that holds it, one for each cell it visits.

    With ``later`` only cells of higher numbers are visited, so that a pair of two cells meets once.
    """

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                home, least = _margins(_matrix(batch.column("u")), pivots)
                rows, cells = np.arange(len(home)), home
                if radius is not None:
                    reach = batch.column(radius).to_numpy(zero_copy_only=False)[:, None] if isinstance(radius, str) else radius
                    numbers = np.arange(len(pivots))
                    visits = (least <= reach + _SLACK) & (numbers > home[:, None] if later else numbers != home[:, None])
                    more, to = np.nonzero(visits)
                    rows, cells = np.concatenate([rows, more]), np.concatenate([cells, to])
                taken = batch.take(pa.array(rows))
                at_home = np.arange(len(rows)) < len(home)
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cells, pa.int32()), pa.array(at_home)], names=[*taken.schema.names, "cell", "home"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in units.schema) + ", cell int, home boolean"
    return units.mapInArrow(deal, schema)


def _blocks(cells: DataFrame, keys: list[str], id: str, both: bool) -> DataFrame:
    """Rows dealt to pairs of blocks ``a, b``: ``own`` is the row's block. Rows at home meet all others; visitors meet those at home.

    With ``both`` rows at home also meet each other, each pair of blocks once.
    """
    hashed = F.xxhash64(F.expr(id))
    sizes = cells.groupBy(*keys).agg(F.count_if("home").alias("h"), F.count_if(~F.col("home")).alias("v")).where(f"h + v > {BLOCK}")
    x = cells.join(sizes, keys, "left")
    count = lambda c: F.greatest(F.ceil(F.coalesce(c, F.lit(1)) / BLOCK), F.lit(1)).cast("int")
    x = x.withColumn("nh", count("h")).withColumn("nv", count("v")).withColumn("own", F.when(F.col("home"), F.pmod(hashed, "nh")).otherwise(F.col("nh") + F.pmod(hashed, "nv")).cast("int"))
    upto = lambda a, b: F.sequence(a, b - 1)
    pair = lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    with_visitors = F.transform(upto(F.col("nh"), F.col("nh") + F.col("nv")), lambda b: pair(F.col("own"), b))
    at_home = F.concat(F.transform(upto(F.lit(0), F.col("nh")), lambda b: pair(F.col("own"), b)), with_visitors) if both else with_visitors
    visiting = F.transform(upto(F.lit(0), F.col("nh")), lambda a: pair(a, F.col("own")))
    x = x.withColumn("to", F.explode(F.when(F.col("home"), at_home).otherwise(visiting)))
    return x.select(*cells.columns, "own", F.col("to.a").alias("a"), F.col("to.b").alias("b"))


def _shuffled_copies(units: DataFrame, pivots: np.ndarray, rows: int, radius: float) -> tuple[float, float]:
    """For cells within a radius, of a sample of rows: how often a row is moved, and the share of other cells that it meets."""
    few = units.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(max(1, rows // SAMPLE))) == 0).select("u").limit(2 * SAMPLE).toArrow().column("u")
    if not len(few) or len(pivots) < 2:
        return 1.0, 1.0
    home, least = _margins(_matrix(few), pivots)
    visits = float(((least <= radius + _SLACK) & (np.arange(len(pivots)) != home[:, None])).sum(axis=1).mean())
    return 2 + visits / 2, visits / (len(pivots) - 1)


def _sides(units: DataFrame, sizes: DataFrame, side: int) -> DataFrame:
    """Rows of a group dealt to all pairs ``a, b`` of its blocks of about ``side`` rows."""
    parts = sizes.select("g", F.ceil(F.col("n") / side).cast("int").alias("parts"))
    x = units.join(parts, "g").withColumn("own", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    x = x.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return x.select("g", F.lit(0).alias("cell"), F.least("own", "to").alias("a"), F.greatest("own", "to").alias("b"), "own", "id", "u")


def similar_pairs(vectors: DataFrame, group: str | None, key: str | Column, vector: str, least: float, strict: bool = False) -> DataFrame:
    """All pairs of a group (of the table without one) at or above a cosine: ``g, a, b, sim``, the lesser key first.

    Keys may be of any orderable type. Null vectors, vectors of length 0 and rows of a null group have no partner. Where
    the bounds rule out few cells, and a row would be moved to more of these than its group has blocks of up to
    ``SIDES * BLOCK`` rows, the groups are dealt to pairs of such blocks without cells, vectors as they are stored.
    """
    id = F.col(key) if isinstance(key, str) else key
    stored = F.col(vector) if vectors.schema[vector].dataType.simpleString() == "array<float>" else F.col(vector).cast("array<double>")
    units = _units(vectors, vector, g=F.col(group) if group else F.lit(0), id=id, stored=stored).where("some AND g IS NOT NULL").drop("some")
    sizes = units.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    rows, most = sizes.agg(F.sum("n"), F.max("n")).first()
    kind = units.schema
    g, k = kind["g"].dataType.simpleString(), kind["id"].dataType.simpleString()
    if not rows:
        return vectors.sparkSession.createDataFrame([], f"g {g}, a {k}, b {k}, sim double")
    pivots, radius = _pivots(units.withColumn("some", F.lit(True)), rows, "id"), float(np.sqrt(max(0.0, 2 - 2 * least)))
    side = BLOCK * max(1, min(SIDES, most // (8 * BLOCK)))
    copies, share = _shuffled_copies(units, pivots, rows, radius)
    if whole := share >= DENSE and copies >= min(-(-most // side), len(pivots)):
        dealt = _sides(units.select("g", "id", F.col("stored").alias("u")), sizes, side)
    else:
        dealt = _blocks(_cells(units.drop("stored"), pivots, radius, True), ["g", "cell"], "id", True)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        a, b, own = (table.column(c).to_numpy() for c in ("a", "b", "own"))
        left, right = np.flatnonzero(own == a), np.flatnonzero(own == b)
        u = _matrix(table.column("u")).astype(np.float64, copy=False)
        u = u / np.sqrt((u * u).sum(axis=1))[:, None] if whole else u
        same, names, of = a[0] == b[0], table.column("id").combine_chunks(), table.column("g").combine_chunks()
        others = u[right]
        # A stretch of rows at a time, so that neither the products nor the pairs of two blocks are together.
        for start in range(0, len(left), STRETCH):
            skip = start if same else 0
            sims = u[left[start : start + STRETCH]] @ others[skip:].T
            i, j = np.nonzero(sims > least if strict else sims >= least)
            if same:
                once = i < j
                i, j = i[once], j[once]
            s, x, y = sims[i, j], pa.array(left[i + start]), pa.array(right[j + skip])
            yield pa.RecordBatch.from_arrays([of.take(x), names.take(x), names.take(y), pa.array(s)], names=["g", "x", "y", "sim"])

    found = dealt.select("g", "cell", "a", "b", "own", "id", "u").groupBy("g", "cell", "a", "b").applyInArrow(compare, f"g {g}, x {k}, y {k}, sim double")
    return found.select("g", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "sim")


def compared_share(vectors: DataFrame, vector: str, key: str, least: float) -> tuple[int, int]:
    """Pairs that ``similar_pairs`` compares over the whole table, and all pairs: what the bounds prune."""
    units = _units(vectors, vector, id=F.col(key)).where("some")
    n = units.count()
    pivots = _pivots(units, n, "id")
    if not len(pivots):
        return 0, 0
    sizes = _cells(units, pivots, float(np.sqrt(max(0.0, 2 - 2 * least))), True).groupBy("cell").agg(F.count_if("home").alias("h"), F.count_if(~F.col("home")).alias("v"))
    return int(sizes.agg(F.coalesce(F.sum(F.expr("h * (h - 1) div 2 + h * v")), F.lit(0))).first()[0]), n * (n - 1) // 2


def best_of(sims: np.ndarray, ids: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
    """The k best of every row by similarity, then id; entries of minus infinity are none."""
    kth = np.partition(sims, -k, axis=1)[:, -k] if sims.shape[1] > k else np.full(len(sims), -np.inf)
    out = []
    for row, least in zip(sims, kth, strict=True):
        at = np.flatnonzero((row >= least) & (row > -np.inf))
        at = at[np.lexsort((ids[at], -row[at]))[:k]]
        out.append(list(zip(row[at].tolist(), ids[at].tolist(), strict=True)))
    return out


_FOUND = "query bigint, id bigint, sim double"


def nearest_by_cells(corpus: DataFrame, queries: DataFrame, key: str, vector: str, k: int, least: float | None = None, others: bool = True) -> DataFrame:
    """``query, id, sim``: at least the k best of every query, exactly, for a query set of any size.

    A query's k best at home bound how far it need look; then it visits only cells that may hold something as good.
    With ``others`` a row does not find its own key. A vector of length 0 is similar to nothing (0), and is found only where nothing better is.
    """
    c = _units(corpus, vector, id=F.col(key).cast("long"), query=F.lit(None).cast("long"), reach=F.lit(0.0)).drop("some")
    q = _units(queries, vector, id=F.lit(None).cast("long"), query=F.col(key).cast("long"), reach=F.lit(0.0)).drop("some")
    pivots = _pivots(c.withColumn("some", F.expr("exists(u, x -> x <> 0)")), c.count(), "id")
    if not len(pivots):
        pivots = np.zeros((1, len((c.first() or {"u": [0.0]})["u"])))
    stored = _cells(c, pivots, None, False)

    def search(table: pa.Table) -> pa.Table:
        asked = table.column("query").is_valid().to_numpy()
        u = _matrix(table.column("u"))
        ids, names = table.column("id").to_numpy()[~asked].astype(np.int64), table.column("query").to_numpy()[asked].astype(np.int64)
        if not len(ids) or not len(names):
            return pa.table({"query": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
        sims = u[asked] @ u[~asked].T
        if others:
            sims[names[:, None] == ids] = -np.inf
        rows = [(n, i, s) for n, found in zip(names.tolist(), best_of(sims, ids, k), strict=True) for s, i in found]
        a, b, s = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table({"query": pa.array(a, pa.int64()), "id": pa.array(b, pa.int64()), "sim": pa.array(s, pa.float64())})

    def meet(asking: DataFrame) -> DataFrame:
        asked = asking.select("cell").distinct()  # at most one a pivot
        both = _blocks(stored.join(F.broadcast(asked), "cell", "left_semi").select(stored.columns).unionByName(asking.withColumn("home", F.lit(False))), ["cell"], "coalesce(id, query)", False)
        return both.select("cell", "a", "b", "query", "id", "u").groupBy("cell", "a", "b").applyInArrow(search, _FOUND)

    near = meet(_cells(q, pivots, None, False))
    w = Window.partitionBy("query").orderBy(F.desc("sim"), "id")
    floor = near.withColumn("r", F.row_number().over(w)).where(F.col("r") == k).select("query", F.col("sim").alias("floor"))
    if least is not None:
        floor = q.select("query").join(floor, "query", "left").select("query", F.greatest(F.coalesce("floor", F.lit(-2.0)), F.lit(float(least))).alias("floor"))
    asking = q.drop("reach").join(floor, "query", "left").withColumn("reach", F.sqrt(F.greatest(2 - 2 * F.coalesce("floor", F.lit(-2.0)), F.lit(0.0)))).select("id", "query", "reach", "u")
    return near.unionByName(meet(_cells(asking, pivots, "reach", False).where("NOT home")))
