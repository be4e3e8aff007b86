"""Hard negatives by inner product, found through an orthogonal rotation to principal components.

Vectors are integers; their Gram matrix, summed over all rows by partial matrices, gives an orthogonal rotation under which
the leading components hold most of the length. Anchors go out in blocks of bounded size. In a task, tiles of anchors and
rows get the partial product of the leading components; the rest is bounded by the product of the residual norms, with slack
for rounding. What can't reach the scores that are still wanted is discarded, what is left gets more components and is
bounded again, and survivors are verified by integer products of the vectors as they are. So the result is exact whatever the
rotation; only the work depends on it.

There are two passes for each block of anchors: the first finds each anchor's positives, the second the negatives in the
windows under these positives' scores. A task keeps the best few of each anchor (or anchor and positive) that it has seen, and
the tasks' few meet in a window by anchor.

Defined results: rows with a null label, a null vector or a component that is null or not finite take no part; neither do rows
without an id, as a result could not name them. Vectors of different lengths are compared as if padded by zeros; an empty
vector scores 0. Ties go to the smaller id. Rows that share an anchor's id are never its positives or negatives; repeated rows
count each, as anchors too. An anchor without positives, and a positive without negatives, give no rows; an empty table gives
an empty result; other columns are ignored. Products that do not fit 64 bits raise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.prep import number
from .session import cut, partitions, read

POSITIVES = NEGATIVES = 5
#: The window under a positive's score, in hundredths of it.
LOW, HIGH = 80, 100
SCALE = 256
#: Anchors in a block: with 64 components, 2 MB of numbers that are broadcast at a time.
ANCHORS = 4096
#: Anchors and rows in a tile of partial products, and pairs whose vectors are gathered at once.
TILE_ANCHORS, TILE_ROWS, PAIRS = 512, 2048, 1 << 15
#: Shares of the components after which pairs are bounded.
STEPS = (0.125, 0.25, 0.5)
LEAST = np.iinfo(np.int64).min


def integers(vector: Column, scale: int = SCALE) -> Column:
    """Components as ``floor(scale * x)``, x as double; null for a vector with a component that is null or not finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~odd, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as the rows of a matrix, short ones padded by zeros."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _gram(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            q = matrix(batch.column(0), width).astype(np.float64)
            total += q.T @ q
        yield pa.record_batch([pa.array(np.arange(width)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    return run


def rotation(rows: DataFrame, width: int) -> np.ndarray:
    """An orthogonal matrix whose leading columns are the directions in which the vectors ``q`` are longest. The driver gets
    the Gram matrix, ``width`` by ``width`` numbers."""
    parts = rows.select("q").mapInArrow(_gram(width), "i long, row array<double>").select("i", F.posexplode("row").alias("j", "x"))
    gram = np.zeros((width, width))
    for r in parts.groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
        gram[r.i, r.j] = r.x
    gram = (gram + gram.T) / 2
    return np.linalg.eigh(gram)[1][:, ::-1] if np.isfinite(gram).all() else np.eye(width)


class Best:
    """The best ``k`` of each of some slots seen so far: higher scores first, ties by smaller id."""

    def __init__(self, slots: int, k: int):
        self.slots, self.k = slots, k
        self.slot, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))
        self.floor = np.full(slots, LEAST)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, ids = np.concatenate([self.slot, slot]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        keep = rank < self.k
        self.slot, self.score, self.id = slot[keep], score[keep], ids[keep]
        full = rank[keep] == self.k - 1
        self.floor[self.slot[full]] = self.score[full]


class Turned:
    """Vectors and their rotated form, with what is needed to bound products: norms of what lies behind each step."""

    def __init__(self, q: np.ndarray, turn: np.ndarray, steps: list[int]):
        self.q, self.r = q, q.astype(np.float64) @ turn
        squares = np.cumsum((self.r * self.r)[:, ::-1], axis=1)[:, ::-1]  # of each component and all behind it
        self.rest = {m: np.sqrt(squares[:, m]) if m < q.shape[1] else np.zeros(len(q)) for m in steps}
        self.norm = np.sqrt(squares[:, 0]) if q.shape[1] else np.zeros(len(q))


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two integer matrices, row by row."""
    if a.size and int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1] >= 1 << 63:
        raise ValueError("inner products do not fit 64 bits: scale the vectors down")
    return np.einsum("ij,ij->i", a, b)


def settle(anchors: Turned, rows: Turned, steps: list[int], slack: float, open_: np.ndarray, least, most: np.ndarray, found) -> None:
    """Finds the pairs of a tile whose product may count. ``open_``: the pairs (anchors by rows) that are in question;
    ``least()``: the score an anchor's pairs must reach just now; ``most``: the one they must not exceed; ``found`` gets
    anchors, rows and exact products of the survivors, those that promise each anchor most first."""
    first = steps[0]
    near = anchors.r[:, :first] @ rows.r[:, :first].T
    room = anchors.rest[first][:, None] * rows.rest[first][None, :] + slack * anchors.norm[:, None] * rows.norm[None, :] + 1
    i, j = np.nonzero(open_ & (near + room >= least()[:, None]) & (near - room <= most[:, None]))
    order = np.lexsort((-(near[i, j] + room[i, j]), i))
    i, j = i[order], j[order]
    order = np.argsort(np.arange(len(i)) - np.searchsorted(i, i), kind="stable")  # each anchor's first, each anchor's second, ...
    i, j = i[order], j[order]
    size, at = 8 * len(anchors.q), 0  # a first look at every anchor's best gives bounds for the rest
    while at < len(i):
        a, b = i[at : at + size], j[at : at + size]
        at, size = at + size, min(2 * size, PAIRS)
        low, high = least(), most
        part = near[a, b]
        for m, behind in zip(steps, [*steps[1:], None], strict=True):
            room = anchors.rest[m][a] * rows.rest[m][b] + slack * anchors.norm[a] * rows.norm[b] + 1
            stay = (part + room >= low[a]) & (part - room <= high[a])
            a, b, part = a[stay], b[stay], part[stay]
            if behind is not None and len(a):
                part = part + np.einsum("ij,ij->i", anchors.r[a, m:behind], rows.r[b, m:behind])
        if len(a):
            found(a, b, exact(anchors.q[a], rows.q[b]))


def steps_of(width: int) -> list[int]:
    return sorted({max(1, round(width * s)) for s in STEPS}) if width else [0]


def slack_of(width: int) -> float:
    """What rounding may change of a product, of the norms' product: turning and adding up ``width`` components, twice over."""
    return 8.0 * (width + 4) ** 2 * np.finfo(float).eps


def _tiles(batches: Iterator[pa.RecordBatch], width: int, turn: np.ndarray, steps: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, Turned]]:
    """Ids, labels and vectors of ``id, label, q`` rows, a tile of them at a time."""
    for batch in batches:
        for at in range(0, len(batch), TILE_ROWS):
            own = batch.slice(at, TILE_ROWS)
            yield own.column(0).to_numpy(), own.column(1).to_numpy(), Turned(matrix(own.column(2), width), turn, steps)


def _out(best: Best) -> Iterator[pa.RecordBatch]:
    yield pa.record_batch([pa.array(best.slot), pa.array(best.id), pa.array(best.score)], names=["slot", "id", "score"])


FOUND = "slot long, id long, score long"


def _positives(shared, k: int):
    """The best ``k`` rows of the label of each anchor; slots are the anchors' places in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, q, turn = shared.value
        width = q.shape[1]
        steps, slack, best = steps_of(width), slack_of(width), Best(len(ids), k)
        of = {v: np.flatnonzero(labels == v) for v in np.unique(labels)}
        turned = {v: Turned(q[own], turn, steps) for v, own in of.items()}
        for row_ids, row_labels, rows in _tiles(batches, width, turn, steps):
            for v in np.intersect1d(row_labels, labels):
                mine = np.flatnonzero(row_labels == v)
                part = _part(rows, mine)
                for at in range(0, len(of[v]), TILE_ANCHORS):
                    own = of[v][at : at + TILE_ANCHORS]
                    settle(
                        _part(turned[v], slice(at, at + TILE_ANCHORS)), part, steps, slack, ids[own][:, None] != row_ids[mine][None, :],
                        lambda own=own: best.floor[own].astype(np.float64), np.full(len(own), np.inf),
                        lambda a, b, score, own=own, mine=mine: best.add(own[a], score, row_ids[mine[b]]),  # noqa: B023
                    )
        yield from _out(best)

    return run


def _part(t: Turned, rows) -> Turned:
    out = object.__new__(Turned)
    out.q, out.r, out.norm, out.rest = t.q[rows], t.r[rows], t.norm[rows], {m: x[rows] for m, x in t.rest.items()}
    return out


def _negatives(shared, k: int, low: int, high: int):
    """The best ``k`` rows of other labels under each positive of an anchor: slots are those positives' places in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, q, turn, owner, score = shared.value  # owner: each positive's anchor, ascending; score: its score
        width = q.shape[1]
        steps, slack, best = steps_of(width), slack_of(width), Best(len(owner), k)
        least = np.array([-(-low * int(s) // 100) for s in score], np.int64)
        most = np.array([high * int(s) // 100 for s in score], np.int64)
        all_turned = Turned(q, turn, steps)
        starts, ends = np.searchsorted(owner, np.arange(len(ids))), np.searchsorted(owner, np.arange(len(ids)), "right")
        some = np.flatnonzero(ends > starts)  # anchors with positives
        top = np.maximum.reduceat(most, starts[some]).astype(np.float64) if len(some) else np.empty(0)

        def wanted(own: np.ndarray) -> np.ndarray:
            """The least score that any positive of an anchor still has use for."""
            return np.minimum.reduceat(np.maximum(least, best.floor), starts[some])[own].astype(np.float64)

        for row_ids, row_labels, rows in _tiles(batches, width, turn, steps):
            for at in range(0, len(some), TILE_ANCHORS):
                place = np.arange(at, min(at + TILE_ANCHORS, len(some)))
                own = some[place]

                def found(a: np.ndarray, b: np.ndarray, product: np.ndarray, own: np.ndarray = own, row_ids: np.ndarray = row_ids) -> None:
                    n = (ends - starts)[own[a]]
                    pair = np.repeat(np.arange(len(a)), n)
                    slot = np.repeat(starts[own[a]] - np.cumsum(n) + n, n) + np.arange(len(pair))
                    fits = (product[pair] >= least[slot]) & (product[pair] <= most[slot]) & (product[pair] >= best.floor[slot])
                    best.add(slot[fits], product[pair][fits], row_ids[b[pair[fits]]])

                open_ = (ids[own][:, None] != row_ids[None, :]) & (labels[own][:, None] != row_labels[None, :])
                settle(_part(all_turned, own), rows, steps, slack, open_, lambda place=place: wanted(place), top[place], found)
        yield from _out(best)

    return run


def _first(found: DataFrame, k: int) -> DataFrame:
    """Of what the tasks found, the best ``k`` of each slot, with their ``rank`` from 1."""
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = ANCHORS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of all rows of ``vectors`` (``vec_id, label,
    q``, q integers, see :func:`integers`) that ``is_anchor``: under each of an anchor's best ``positives`` rows of its label,
    the best ``negatives`` rows of other labels whose score is between ``low`` and ``high`` hundredths of the positive's.

    The driver holds one block of anchors and their positives at a time."""
    spark = vectors.sparkSession
    valid = vectors.filter("vec_id is not null and label is not null and q is not null").select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "q", is_anchor.alias("anchor"))
    rows = cut(valid.repartition(partitions(spark), F.xxhash64("id", "q")))
    width = rows.agg(F.max(F.size("q"))).first()[0] or 0
    turn = rotation(rows, width)
    anchors = cut(number(rows.filter("anchor").select("id", "label", "q"), "id", "label", "q", out="at"))
    found = None
    for start in range(0, anchors.count(), block):
        got = anchors.filter(F.col("at").between(start, start + block - 1)).orderBy("at").toArrow().combine_chunks()
        ids, labels = (got[c].to_numpy() for c in ("id", "label"))
        q = matrix(got["q"].combine_chunks() if isinstance(got["q"], pa.ChunkedArray) else got["q"], width)
        plain = rows.select("id", "label", "q")
        shared = spark.sparkContext.broadcast((ids, labels, q, turn))
        near = _first(plain.mapInArrow(_positives(shared, positives), FOUND), positives).orderBy("slot", "rank").collect()  # of one block
        owner, other, score = (np.array([r[c] for r in near], np.int64) for c in ("slot", "id", "score"))
        windows = spark.sparkContext.broadcast((ids, labels, q, turn, owner, score))
        best = _first(plain.mapInArrow(_negatives(windows, negatives, low, high), FOUND), negatives)
        pairs = spark.createDataFrame(pa.table({"slot": np.arange(len(owner)), "anchor_id": ids[owner], "positive_id": other, "positive_score": score}))
        part = cut(
            best.join(F.broadcast(pairs), "slot")  # the block's anchors times `positives` rows
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        )
        shared.unpersist()
        windows.unpersist()
        found = part if found is None else found.unionAll(part)
    if found is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return found


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(read(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), integers(F.col("embedding")).alias("q")), F.col("vec_id") % 100 == 0)


SQL = """
with v as materialized (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and coalesce(len(list_filter(embedding, lambda x: x is null or not isfinite(x))), 0) = 0),
s as materialized (
  select a.vec_id as a, r.vec_id as r, a.label = r.label as same, coalesce(list_sum(list_transform(list_zip(a.q, r.q), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))), 0)::bigint as score
  from v a join v r on a.vec_id % 100 = 0 and r.vec_id <> a.vec_id),
p as (select a, r, score from s where same qualify row_number() over (partition by a order by score desc, r) <= 5),
n as (
  select p.a, p.r as p, s.r as n, p.score as ps, s.score as ns, row_number() over (partition by p.a, p.r order by s.score desc, s.r) as rank
  from p join s on s.a = p.a and not s.same and 80 * p.score <= 100 * s.score and 100 * s.score <= 100 * p.score)
select a as anchor_id, p as positive_id, rank::integer as rank, n as negative_id, ps as positive_score, ns as negative_score from n where rank <= 5
"""
