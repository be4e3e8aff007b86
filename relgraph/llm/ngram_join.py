"""N-gram Jaccard join by MinHash banding.

A text is the set of its word 5-grams (its whole word sequence if it has fewer words). Texts with equal sets are one class,
so copies are never paired. Each class is hashed to ``bands`` bands of ``rows`` MinHashes, chosen for the target recall at the
threshold, and classes are shuffled by band hash. A bucket is not expanded into pairs: it links its members to its smallest
one, and the components of these links hold every pair that shares a bucket. Within a component all pairs of classes are
verified on their full n-gram sets, in blocks of at most ``BLOCK`` classes against ``BLOCK``; a task returns, for each class,
the number of linked documents and a spanning tree of the links, never the links themselves. So no link between candidates
is lost, memory is bounded by the sets of two blocks, and a large group of near copies spreads over many tasks. Where rows meet
their bucket, component, class or n-gram set, keys that hold more than one row in 1024 are dealt over many tasks.

Defined results: null texts and texts without words link to nothing; copies (equal n-gram sets) link to each other; repeated
rows are copies; a null ``doc_id`` is a document whose id is never a class id (its class is null if no other member has an
id); an empty table gives an empty result; other columns are ignored. Whole texts are used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import star_edges
from .session import cut, partitions, read, spread_join
from .words import U, fold, mix, slices, split_words

NGRAM, THRESHOLD, RECALL, MOST_HASHES, BLOCK = 5, 0.8, 0.999, 160, 512


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """``bands, rows``: the most selective banding (most rows) that finds a pair at the threshold with probability ``recall``
    using at most ``most`` hashes."""
    best = (most, 1)
    for rows in range(1, most + 1):
        bands = int(np.ceil(np.log(1 - recall) / np.log1p(-(threshold**rows))))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def ngram_sets(texts: pa.Array, n: int = NGRAM) -> Iterator[np.ndarray]:
    """Each text's sorted distinct n-gram hashes."""
    for a, b in slices(texts):
        words = split_words(texts.slice(a, b - a))
        grams, bounds = fold(words.hashes, n), words.bounds
        for i in range(b - a):
            lo, hi = int(bounds[i]), int(bounds[i + 1])
            if hi - lo >= n:
                yield np.unique(grams[lo : hi - n + 1])
            else:
                yield fold(words.hashes[lo:hi], hi - lo) if hi > lo else np.zeros(0, U)


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """``[sets, bands]`` hashes of non-empty sets."""
    sizes = np.array([len(s) for s in sets])
    all_, starts = np.concatenate(sets), np.cumsum(sizes) - sizes
    rng = np.random.default_rng(5)
    salts, odds = rng.integers(0, 1 << 63, bands * rows, dtype=U), rng.integers(0, 1 << 63, bands * rows, dtype=U) * U(2) + U(1)
    out = np.empty((len(sets), bands), U)
    for band in range(bands):
        h = np.full(len(sets), U(band))
        for k in range(band * rows, (band + 1) * rows):
            h = mix(h + np.minimum.reduceat((all_ ^ salts[k]) * odds[k], starts))
        out[:, band] = h
    return out


def _signatures(bands: int, rows: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = batch.column(3), 0
            for a, b in slices(texts):
                sets = list(ngram_sets(texts.slice(a, b - a), n))
                full = [s for s in sets if len(s)]
                hashes = iter(band_hashes(full, bands, rows)) if full else iter(())
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                lists = [next(hashes).view(np.int64) if len(s) else None for s in sets]
                yield pa.record_batch(
                    [*(batch.column(k).slice(at, b - a) for k in range(3)), pa.array(digests, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(lists, pa.list_(pa.int64()))],
                    names=["doc_id", "t1", "t2", "digest", "n", "bands"],
                )
                at += b - a

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for a, b in slices(batch.column(4)):
                sets = [s.tobytes() for s in ngram_sets(batch.column(4).slice(a, b - a), n)]
                yield pa.record_batch([*(batch.column(k).slice(at, b - a) for k in range(4)), pa.array(sets, pa.binary())], names=["cid", "comp", "blocks", "size", "grams"])
                at += b - a

    return run


def intersections(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of all sets of ``left`` with all of ``right`` (or of ``left``), by matrix products over
    slices of the shared vocabulary."""
    sets = left + (right or [])
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    keep = count[column] > 1
    rows, column = rows[keep], shared[column[keep]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    total, wide = int((count > 1).sum()), 4096
    out = np.zeros((len(left), len(right) if right is not None else len(left)), np.float32)
    for c in range(0, total, wide):
        a, b = np.searchsorted(column, [c, c + wide])
        x = np.zeros((len(sets), min(wide, total - c)), np.float32)
        x[rows[a:b], column[a:b] - c] = 1
        out += x[: len(left)] @ (x[len(left) :] if right is not None else x).T
    return out


def verify_block(cids: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], side: np.ndarray, within: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For the classes of a block pair (``side`` 0 and 1; ``within``: a block with itself): the documents linked to each in this
    pair of blocks, and the smallest class it is connected with."""
    n, left, right = np.array([len(s) for s in sets]), np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if within:
        right = left
    if not len(left) or not len(right):
        return np.zeros(len(cids), np.int64), cids
    inter = intersections([sets[i] for i in left], None if within else [sets[i] for i in right])
    linked = inter >= threshold * (n[left][:, None] + n[right][None, :] - inter) - 1e-6
    if within:
        np.fill_diagonal(linked, False)
    links = np.zeros(len(cids), np.int64)
    links[left] += linked @ sizes[right]
    if not within:
        links[right] += linked.T @ sizes[left]
    root = cids.copy()
    while True:  # smallest label over the links, with every pass taking whole rows
        new = root.copy()
        big = np.iinfo(np.int64).max
        new[left] = np.minimum(new[left], np.where(linked, root[right][None, :], big).min(1, initial=big))
        if not within:
            new[right] = np.minimum(new[right], np.where(linked.T, new[left][None, :], big).min(1, initial=big))
        if (new == root).all():
            return links, root
        root = new


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by ``comp, i, j``; a group may span batches."""
        key, held = None, []

        def done() -> pa.RecordBatch:
            cids, sizes, side = (np.array([r[k] for r in held]) for k in (0, 1, 2))
            links, root = verify_block(cids, sizes, [np.frombuffer(r[3], U) for r in held], side, key[1] == key[2], threshold)
            return pa.record_batch([pa.array(cids), pa.array(links), pa.array(root), pa.array([key[3] for _ in held], pa.bool_())], names=["cid", "links", "root", "split"])

        for batch in batches:
            d = batch.to_pydict()
            for comp, i, j, blocks, cid, size, side, grams in zip(*(d[c] for c in ("comp", "i", "j", "blocks", "cid", "size", "side", "grams")), strict=True):
                if key is not None and key[:3] != (comp, i, j):
                    yield done()
                    held = []
                key = (comp, i, j, blocks > 1)
                held.append((cid, size, side, grams))
        if held:
            yield done()

    return run


def link_classes(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, class_id`` (the smallest id among the documents it is connected with by
    links), ``n_links`` (documents with a similarity of ``threshold`` or more to it)."""
    bands, rows = choose_bands(threshold, recall)
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("t1"), F.xxhash64(F.lit(3), text_col).alias("t2"), F.col(text_col).alias("text"))
    signed = cut(texts.mapInArrow(_signatures(bands, rows, n), f"doc_id {kind}, t1 long, t2 long, digest binary, n long, bands array<long>"))
    classes = signed.filter("digest is not null").groupBy("digest").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("doc_id", "t1", "t2", "bands")).alias("first"), F.min("doc_id").alias("least_id"))
    classes = cut(classes.select("digest", "size", "least_id", "first.doc_id", "first.t1", "first.t2", "first.bands", F.monotonically_increasing_id().alias("cid")))

    buckets = classes.select("cid", F.explode("bands").alias("bucket"))
    least = cut(buckets.groupBy("bucket").agg(F.min("cid").alias("least"), F.count(F.lit(1)).alias("m")).filter("m > 1"))
    stars = spread_join(buckets, least, "bucket", "m", bands * classes.count()).filter("cid <> least").select(F.col("cid").alias("src"), F.col("least").alias("dst")).distinct()
    linked = star_edges(stars)
    comps = cut(linked.select(F.col("v").alias("cid"), F.col("label").alias("comp")).unionAll(linked.select(F.col("label").alias("cid"), F.col("label").alias("comp")).distinct()))
    blocks = cut(comps.groupBy("comp").agg(F.count(F.lit(1)).alias("m"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")))

    # the text of one document of each class that has a candidate, and its n-gram set
    wanted = classes.join(spread_join(comps, blocks, "comp", "m", comps.count()), "cid").select("cid", "comp", "blocks", "size", F.col("doc_id").alias("own"), F.col("t1").alias("k1"), F.col("t2").alias("k2"))
    found = texts.join(wanted, (F.col("t1") == F.col("k1")) & (F.col("t2") == F.col("k2")) & F.col("doc_id").eqNullSafe(F.col("own")))
    sets = found.select("cid", "comp", "blocks", "size", "text").dropDuplicates(["cid"]).mapInArrow(_sets(n), "cid long, comp long, blocks int, size long, grams binary")

    mine = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    dealt = sets.withColumn("mine", mine).withColumn("other", F.explode(others)).select(
        "comp", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "blocks", "cid", "size", (F.col("mine") > F.col("other")).cast("int").alias("side"), "grams"
    )
    verified = dealt.repartition(partitions(spark), "comp", "i", "j").sortWithinPartitions("comp", "i", "j").mapInArrow(_verify(threshold), "cid long, links long, root long, split boolean")
    verified = cut(verified)
    links = verified.groupBy("cid").agg(F.sum("links").alias("links"), F.min("root").alias("root"), F.max("split").alias("split"))
    across = verified.filter("split").select(F.col("cid").alias("src"), F.col("root").alias("dst")).filter("src <> dst").distinct()
    joined = star_edges(across).select(F.col("v").alias("cid"), F.col("label").alias("joined"))
    grouped = links.join(joined, "cid", "left").select("cid", "links", F.when(F.col("split"), F.coalesce("joined", "cid")).otherwise(F.col("root")).alias("root"))

    resolved = cut(classes.select("cid", "digest", "size", "least_id").join(grouped, "cid", "left").withColumn("root", F.coalesce("root", "cid")))
    names = resolved.groupBy("root").agg(F.min("least_id").alias("class_id"), F.count(F.lit(1)).alias("m"))
    named = spread_join(resolved, names, "root", "m", resolved.count())
    final = cut(named.select("digest", "class_id", "size", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    rows_ = signed.select("doc_id", "digest")
    with_words = spread_join(rows_.filter("digest is not null"), final, "digest", "size", signed.count()).select("doc_id", "class_id", "n_links")
    without = rows_.filter("digest is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return with_words.unionAll(without)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_classes(read(spark, sf_dir, "documents"))
