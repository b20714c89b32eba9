"""Embedding near-dedup: an exact range join over cells around pivots."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardbook.llm.components import components
from wardbook.llm.support import small_batches, table, written

MIN_COSINE = 0.9
PIVOT_ROWS = 4096
"""Distinct vectors for each pivot."""
MAX_PIVOTS = 512
"""Bound of the pivots, which are collected and sent to every task."""
BLOCK_ROWS = 4096
"""Vectors of a cell that are compared as one side of a pair of blocks."""
BLOCK_BYTES = 1 << 20
"""Bytes of the numbers of a block; long vectors make blocks of fewer rows."""
SIDE_PARTS = (64, 512)
"""Most partitions of the blocks as left and as right side; each two make a task."""
_SLACK = 1e-9
_TILE = 512
_OWN_FILES = {  # some blocks for each row group, as a reader holds one whole
    "parquet.block.size": 1 << 22,
    "parquet.block.size.row.check.min": 1,
    "parquet.page.size.row.check.min": 1,
    "parquet.enable.dictionary": "false",
}
_KNOWN = ("k1", "k2", "low", "size")
_FOUND = pa.schema([(c, pa.int64()) for c in ("k1", "k2", "n", "a", "b")])


def _unit(rows: np.ndarray) -> np.ndarray:
    m = np.asarray(rows, np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _numbers(lists: pa.Array, width: int) -> np.ndarray:
    """Vectors of one dimension as a matrix: single precision as it is, any other type as double."""
    flat = lists.flatten()
    if flat.type != pa.float32():
        flat = flat.cast(pa.float64(), safe=False)
    return flat.to_numpy(zero_copy_only=False).reshape(-1, width)


def homes_of(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each vector with its home cell, that of the nearest pivot; vectors of another dimension have a cell for each dimension."""
    for batch in batches:
        lists = batch.column("embedding")
        width = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        cell = (-1 - width).astype(np.int32)
        same = width == pivots.shape[1]
        if same.any():
            cell[same] = (_unit(_numbers(lists.filter(pa.array(same)), pivots.shape[1])) @ pivots.T).argmax(axis=1)
        yield batch.append_column("cell", pa.array(cell, pa.int32()))


def _margins(unit: np.ndarray, cell: int, others: np.ndarray | slice, pivots: np.ndarray) -> np.ndarray:
    """How far each vector lies on the own side of the planes between its cell's pivot and others; the own pivot has no plane."""
    away = pivots[cell] - pivots[others]
    apart = np.linalg.norm(away, axis=1)
    return np.where(apart > 0, (unit @ away.T) / np.where(apart > 0, apart, 1), -np.inf)


def packed(rows: pa.Table, pivots: np.ndarray) -> pa.Table:
    """The vectors of a block as one row of bytes, with the least margin of any of them to each other cell."""
    cell, chunk = rows["cell"][0].as_py(), rows["chunk"][0].as_py()
    lists = rows["embedding"].combine_chunks()
    vectors = _numbers(lists, len(lists.flatten()) // len(lists))
    margin = _margins(_unit(vectors), cell, slice(None), pivots).min(axis=0) if cell >= 0 else []
    columns = {"cell": pa.array([cell], pa.int32()), "chunk": pa.array([chunk], pa.int32())}
    columns |= {c: pa.array([rows[c].to_numpy().astype(np.int64).tobytes()], pa.binary()) for c in _KNOWN}
    columns["vectors"] = pa.array([vectors.tobytes()], pa.binary())
    columns["margin"] = pa.array([margin], pa.list_(pa.float64()))
    return pa.table(columns)


class _Block:
    """A block in a task: counts and labels stay for all pairs of the task, vectors only where they are in use."""

    def __init__(self, row: dict, at: int):
        self.k1, self.k2, self.low, self.size = (
            np.frombuffer(row[c][at].as_buffer(), np.int64).copy() for c in _KNOWN
        )
        self.label = self.low.copy()
        self.n = np.zeros(len(self.low), np.int64)


def _sides(value: pa.Scalar, rows: int, single: bool) -> tuple[np.ndarray, np.ndarray]:
    unit = _unit(np.frombuffer(value.as_buffer(), np.float32 if single else np.float64).reshape(rows, -1))
    return unit, unit.astype(np.float32)


def _join(x: _Block, y: _Block, i: np.ndarray, j: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """Gives linked rows ``i`` of ``x`` and ``j`` of ``y`` the least label among them; the labels that this made one, as pairs."""
    p, q = x.label[i], y.label[j]
    top = np.iinfo(np.int64).max
    while True:
        next_p = np.minimum(p, np.where(linked, q[None, :], top).min(axis=1))
        next_q = np.minimum(q, np.where(linked, next_p[:, None], top).min(axis=0))
        if (next_p == p).all() and (next_q == q).all():
            break
        p, q = next_p, next_q
    pairs = np.stack([np.r_[x.label[i], y.label[j]], np.r_[p, q]], axis=1)
    x.label[i] = np.minimum(x.label[i], p)
    y.label[j] = np.minimum(y.label[j], q)
    return np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)


def _tiles(rows: np.ndarray) -> list[np.ndarray]:
    return [rows[at : at + _TILE] for at in range(0, len(rows), _TILE)]


def compare(
    x: _Block, y: _Block, left: tuple, right: tuple, i: np.ndarray, j: np.ndarray, min_cosine: float
) -> Iterator[np.ndarray]:
    """Counts the links of rows ``i`` of ``x`` and ``j`` of ``y``, and yields pairs of labels that connect what is linked.

    Single precision, by a bound of its error, tells which rows and columns of a
    tile may hold links; those are compared in double precision.
    """
    (exact_x, x32), (exact_y, y32) = left, right
    few = min_cosine - 4 * (x32.shape[1] + 16) * 2.0**-24
    for rows, columns in product(_tiles(i), _tiles(j)):
        near = x32[rows] @ y32[columns].T
        if near.max() < few:
            continue
        hit = near >= few
        rows, columns = rows[hit.any(axis=1)], columns[hit.any(axis=0)]
        linked = exact_x[rows] @ exact_y[columns].T >= min_cosine
        if x is y:
            linked &= rows[:, None] != columns
        by_row, by_column = linked.any(axis=1), linked.any(axis=0)
        if not by_row.any():
            continue
        rows, columns, linked = rows[by_row], columns[by_column], linked[np.ix_(by_row, by_column)]
        x.n[rows] += np.rint(linked @ y.size[columns].astype(np.float64)).astype(np.int64)
        if x is not y:
            y.n[columns] += np.rint(x.size[rows].astype(np.float64) @ linked).astype(np.int64)
        yield _join(x, y, rows, columns, linked)


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    rows = len(next(iter(columns.values())))
    arrays = [pa.array(columns[c], pa.int64()) if c in columns else pa.nulls(rows, pa.int64()) for c in _FOUND.names]
    return pa.RecordBatch.from_arrays(arrays, schema=_FOUND)


def links_of(
    batches: Iterator[pa.RecordBatch], pivots: np.ndarray, min_cosine: float, single: bool
) -> Iterator[pa.RecordBatch]:
    """Links within pairs of blocks: how many rows each class links to, and links that connect what is linked.

    A task keeps counts and labels of its blocks over all its pairs. The second kind
    of row says which labels met, so however dense the links, it returns few
    more rows than its blocks have.
    """
    radius = math.sqrt(2 - 2 * min_cosine) + _SLACK
    blocks: dict[tuple, _Block] = {}
    held, left = None, ()
    for batch in batches:
        met = []
        sides = [{c: batch.column(f"{s}_{c}") for c in ("cell", "chunk", *_KNOWN, "vectors", "margin")} for s in "ab"]
        for at in range(batch.num_rows):
            names = [(s["cell"][at].as_py(), s["chunk"][at].as_py()) for s in sides]
            for name, side in zip(names, sides, strict=True):
                if name not in blocks:
                    blocks[name] = _Block(side, at)
            x, y = (blocks[name] for name in names)
            if held != names[0]:
                held, left = names[0], _sides(sides[0]["vectors"][at], len(x.low), single)
            right = left if x is y else _sides(sides[1]["vectors"][at], len(y.low), single)
            i, j = np.arange(len(x.low)), np.arange(len(y.low))
            (ci, _), (cj, _) = names
            if ci != cj:  # only rows that a row of the other side may reach over the plane between the two cells
                own, other = (s["margin"][at].values for s in sides)
                i = i[_margins(left[0], ci, [cj], pivots)[:, 0] + other[ci].as_py() <= radius]
                j = j[_margins(right[0], cj, [ci], pivots)[:, 0] + own[cj].as_py() <= radius]
            met += compare(x, y, left, right, i, j, min_cosine)
        if met:
            a, b = np.concatenate(met).T
            yield _batch(a=a, b=b)
    for block in blocks.values():
        some = block.n > 0
        if some.any():
            yield _batch(k1=block.k1[some], k2=block.k2[some], n=block.n[some])


def near_vectors(
    vectors: DataFrame, min_cosine: float = MIN_COSINE, block_rows: int = BLOCK_ROWS, pivot_rows: int = PIVOT_ROWS
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``(vec_id, embedding)``.

    Vectors link at a cosine of ``min_cosine`` or more, in double precision, whatever
    their other columns. Those that are null, empty, zero or hold null or
    non-finite numbers link with nothing, and vectors of different dimensions
    never link. ``component_id`` is the smallest ``vec_id`` reachable. A row without
    ``vec_id`` links with nothing and has no component. Rows that repeat a
    vector are links of each other.

    Equal vectors become one class before anything is compared, so a vector that a
    third of the rows share costs one row. A cosine bound is a radius between unit
    vectors: each class has a home cell at its nearest pivot, and a pair can only
    link if its ends lie within the radius of each other across the plane
    between their cells. A cell of any size is cut into blocks of ``block_rows``.
    Each two blocks that such a pair may join are read from the shared folder where
    they are compared, in one direction, so no vector is copied or sent for each
    cell or block that it meets, and a task holds two blocks' vectors at a time.
    """
    small_batches(vectors.sparkSession)
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    length = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    usable = F.col("vec_id").isNotNull() & F.coalesce(finite & (length > 0), F.lit(False))
    keys = {"k1": F.xxhash64("embedding"), "k2": F.xxhash64(F.lit(1), "embedding")}
    named = vectors.select("vec_id", "embedding", usable.alias("usable")).withColumns(keys)
    classes = written(
        named.filter("usable")
        .groupBy("k1", "k2")
        .agg(F.first("embedding").alias("embedding"), F.min("vec_id").alias("low"), F.count("*").alias("size"))
    )
    total = classes.count()
    pivot_count = min(MAX_PIVOTS, math.ceil(total / pivot_rows))
    sample = [r[0] for r in classes.orderBy("k1", "k2").select("embedding").limit(pivot_count).collect()]
    pivots = [row for row in sample if len(row) == len(sample[0])]
    pivots = np.unique(_unit(pivots), axis=0) if pivots else np.zeros((0, 0))
    kind = classes.schema["embedding"].dataType.simpleString()
    single = kind == "array<float>"
    columns = f"k1 long, k2 long, embedding {kind}, low long, size long"
    homes = classes.mapInArrow(partial(homes_of, pivots=pivots), f"{columns}, cell int")
    width = F.when(F.col("cell") < 0, -1 - F.col("cell")).otherwise(max(1, pivots.shape[1]))
    most = F.greatest(F.lit(1), F.least(F.lit(block_rows), F.floor(BLOCK_BYTES / (width * (4 if single else 8)))))
    chunks = F.greatest(F.lit(1), F.round(F.col("count") / most)).cast("int")  # up to half as much again in a block
    chunks = written(homes.groupBy("cell").count().select("cell", chunks.alias("chunks")))
    blocks = written(
        homes.join(F.broadcast(chunks), "cell", "left")  # a row for each pivot and dimension
        .withColumn("chunk", F.expr("cast(pmod(k2, coalesce(chunks, 1)) as int)"))
        .drop("chunks")
        .groupBy("cell", "chunk")
        .applyInArrow(
            lambda rows: packed(rows, pivots),
            "cell int, chunk int, k1 binary, k2 binary, low binary, size binary, vectors binary, margin array<double>",
        ),
        _OWN_FILES,
    )
    a, b = (
        blocks.select([F.col(c).alias(f"{side}_{c}") for c in blocks.columns]).coalesce(parts)
        for side, parts in zip("ab", SIDE_PARTS, strict=True)
    )
    reach = math.sqrt(2 - 2 * min_cosine) + _SLACK
    # Each two blocks once, and about as many in one order as in the other, so that all tasks have work.
    once = """(a_cell = b_cell and a_chunk = b_chunk) or
        (pmod(a_cell + a_chunk + b_cell + b_chunk, 2) = 0) = (struct(a_cell, a_chunk) < struct(b_cell, b_chunk))"""
    near = f"a_cell = b_cell or (a_cell >= 0 and b_cell >= 0 and get(a_margin, b_cell) + get(b_margin, a_cell) <= {reach!r}D)"
    found = written(
        a.hint("shuffle_replicate_nl")
        .join(b, F.expr(f"({once}) and ({near})"))
        .mapInArrow(
            partial(links_of, pivots=pivots, min_cosine=min_cosine, single=single),
            "k1 long, k2 long, n long, a long, b long",
        )
    )
    counted = found.filter("n is not null").groupBy("k1", "k2").agg(F.sum("n").alias("others"))
    graph = components(found.filter("a is not null").select("a", "b"))
    known = (
        classes.drop("embedding")
        .join(counted, ["k1", "k2"], "left")
        .join(graph, F.col("low") == F.col("id"), "left")
        .select(
            "k1",
            "k2",
            F.lit(True).alias("usable"),
            (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("n_links"),
            F.coalesce("component_id", "low").alias("component_id"),
        )
    )
    return (
        named.drop("embedding")
        .join(known, ["k1", "k2", "usable"], "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


SQL = """
with recursive usable as (
    select vec_id, embedding::double[] as v from embeddings
    where vec_id is not null and embedding is not null
      and len([x for x in embedding if x is null or not isfinite(x)]) = 0
      and list_sum([x::double * x::double for x in embedding]) > 0
), links as (
    select a.vec_id as a, b.vec_id as b from usable a join usable b on a.vec_id <> b.vec_id and len(a.v) = len(b.v)
    where list_cosine_similarity(a.v, b.v) >= 0.9
), reached(vec_id, origin) as (
    select vec_id, vec_id from embeddings
    union
    select links.b, reached.origin from reached join links on links.a = reached.vec_id
), counted as (
    select a, count(*) as n from links group by a
), least as (
    select vec_id, min(origin) as component_id from reached group by vec_id
)
select e.vec_id, coalesce(n, 0)::bigint as n_links, component_id, e.vec_id = component_id as kept
from embeddings e join least using (vec_id) left join counted on counted.a = e.vec_id
"""
