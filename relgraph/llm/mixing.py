"""Mixing sources to target weights by entropy balancing.

Every document ``i`` of source ``s`` gets a rate ``r_i`` between 0 and ``cap`` copies: of all rates whose tokens add up to
the source's target, those of least (bounded) relative entropy to one copy each. They have the tilted form
``r_i = cap / (1 + (cap - 1) exp(-lam_s x_i))`` with ``x_i`` the size over the source's mean size, and ``lam_s`` solves the
convex dual by safeguarded Newton steps. Gradient and curvature depend on the documents only by their (source, size)
histogram, which one distributed aggregation with map-side combining makes.

Rates become whole copies by carrying the error in tokens from the largest size down: the ``FOLDED`` largest distinct
sizes of a source one after another, the smaller ones by rounding cumulated copies. A source's taken tokens are then
within half of its (FOLDED + 1)-th largest size of what the rates give. Copies of a size level are dealt out by a hash of
the id, in salted buckets whose number grows with the rows, so a level with a third of all rows is never ranked in one task.

Defined results: null text has size 0; a null source is a source of its own, last in order; sizes of 0 take nothing and
get one copy; a source without words has target 0; an empty table gives an empty result; columns besides the three named
ones are ignored; fully repeated rows are separate documents. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .session import cut, read, spread_join

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
FOLDED = 256
#: Rows that a bucket of a level may hold on average if one level has all rows; least number of buckets.
BUCKET_ROWS, BUCKETS = 500_000, 32
#: Sources up to which the dual's variables are broadcast (some 100 bytes each).
BROADCAST_SOURCES = 50_000
ROUNDS = 60
TOLERANCE = 1e-6


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009 to U+000D; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A non-null key in code point order, with null last."""
    return F.when(source.isNull(), F.lit("z")).otherwise(F.concat(F.lit("s"), source))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``skey, source_size`` to ``skey, source_size, target``: weights repeat in key order over ``share`` of all sizes; a
    target stops at ``cap`` times its source's size and the excess is shared anew by weight until none is above. The
    level at which that ends comes from one pass over the sources in the order in which they reach their cap."""
    ordered = sizes.withColumn("rank", F.row_number().over(Window.orderBy("skey")) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = ordered.withColumn("w", w).withColumn("most", cap * F.col("source_size"))
    by_level = Window.orderBy(F.col("most") / F.col("w"), "skey")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (
        rows.withColumn("left", share * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("theta", F.col("left") / F.sum("w").over(after))
        .filter(F.col("theta") * F.col("w") <= F.col("most"))
        .agg(F.max("theta"))
        .first()[0]
    )
    return rows.select("skey", "source_size", (F.col("most") if level is None else F.least(F.col("most"), F.lit(level) * F.col("w"))).alias("target"))


def _rate(lam: Column, x: Column, cap: float) -> Column:
    return cap / (1.0 + (cap - 1.0) * F.exp(-F.greatest(F.least(lam * x, F.lit(700.0)), F.lit(-700.0))))


def _exact(x: Column) -> Column:
    """A sum that does not depend on the order of its terms, each taken to a billionth of a token."""
    return F.sum(F.round(x * 1e9).cast("decimal(38,0)")).cast("double") / 1e9


def solve(hist: DataFrame, wanted: DataFrame, cap: float = CAP, rounds: int = ROUNDS, tolerance: float = TOLERANCE, broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """``lam`` for each source: Newton steps on the dual, kept inside a bracket that shrinks with every step. A source whose
    target is its cap has the rate ``cap`` throughout and takes no part (``lam`` null).

    A round is one distributed aggregation: every (source, size) level adds its share of the gradient and the curvature at its
    source's ``lam``, combined map-side, and the sums move the dual's variables, one a source. Up to ``broadcast_sources`` the
    variables are broadcast to the levels; of more, sources with many levels are dealt over many tasks. Sums do not depend on
    the order of their terms, so reruns agree."""
    scale = hist.groupBy("skey").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale"), F.count(F.lit(1)).alias("m"))
    open_ = cut(wanted.filter((F.col("target") < cap * F.col("source_size") * (1 - 1e-12)) & (F.col("target") > 0)).join(scale, "skey").select("skey", "target", "scale", "m"))
    levels, sources = hist.filter("size > 0").select("skey", "size", "n"), open_.count()
    n_levels = hist.count() if sources > broadcast_sources else 0

    def at_levels(table: DataFrame) -> DataFrame:
        if sources <= broadcast_sources:
            return levels.join(F.broadcast(table), "skey")
        return spread_join(levels, table.join(open_.select("skey", "m"), "skey"), "skey", "m", n_levels)

    state = open_.select("skey", "target", "scale", F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(False).alias("done"))
    tokens, x = F.col("n") * F.col("size"), F.col("size") / F.col("scale")
    rate = _rate(F.col("lam"), x, cap)
    for _ in range(rounds):
        sums = at_levels(state.filter("not done").select("skey", "scale", "lam")).groupBy("skey").agg(_exact(tokens * rate).alias("f"), _exact(tokens * x * rate * (1 - rate / cap)).alias("slope"))
        g, lam = F.col("f") - F.col("target"), F.col("lam")
        now = state.join(sums, "skey", "left").withColumn("lo", F.when(g < 0, lam).otherwise(F.col("lo"))).withColumn("hi", F.when(g > 0, lam).otherwise(F.col("hi")))
        lo, hi, newton, most = F.col("lo"), F.col("hi"), lam - g / F.when(F.col("slope") > 0, F.col("slope")), 4.0 + F.abs(lam)
        inside = newton.isNotNull() & (lo.isNull() | (newton > lo)) & (hi.isNull() | (newton < hi))
        step = F.when(inside, F.greatest(F.least(newton, lam + most), lam - most)).when(lo.isNotNull() & hi.isNotNull(), (lo + hi) / 2).when(hi.isNull(), lam + most).otherwise(lam - most)
        done = F.col("done") | (F.abs(g) <= tolerance * F.col("target"))
        state = cut(now.select("skey", "target", "scale", F.when(done, lam).otherwise(step).alias("lam"), "lo", "hi", done.alias("done")))
        if state.filter("not done").isEmpty():
            break
    return wanted.join(state.select("skey", "lam"), "skey", "left")


def _level_copies(hist: DataFrame, solved: DataFrame, cap: float) -> DataFrame:
    """``skey, size, n, copies``: whole copies of each size level of a source."""
    scale = hist.groupBy("skey").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale"))
    full = F.col("lam").isNull() & (F.col("target") > 0)
    rate = F.when(F.col("size") == 0, 1.0).when(full, F.lit(cap)).when(F.col("lam").isNull(), 0.0).otherwise(_rate(F.col("lam"), F.col("size") / F.col("scale"), cap))
    levels = hist.join(solved.join(scale, "skey"), "skey").select("skey", "size", "n", (F.col("n") * rate).alias("want"))
    down = Window.partitionBy("skey").orderBy(F.desc("size"))
    levels = levels.withColumn("rank", F.row_number().over(down))
    top = levels.filter(F.col("rank") <= FOLDED).groupBy("skey").agg(F.array_sort(F.collect_list(F.struct("rank", "size", "n", "want"))).alias("tops"))

    def carry(acc: Column, x: Column) -> Column:
        exact = x["want"] + acc["carry"] / F.greatest(x["size"], F.lit(1))
        taken = F.greatest(F.lit(0.0), F.least(F.round(exact), cap * x["n"]))
        return F.struct(((x["want"] - taken) * x["size"] + acc["carry"]).alias("carry"), F.concat(acc["taken"], F.array(taken.cast("long"))).alias("taken"))

    folded = top.select("skey", F.posexplode(F.aggregate("tops", F.struct(F.lit(0.0).alias("carry"), F.array().cast("array<bigint>").alias("taken")), carry)["taken"]).alias("at", "folded"))
    cumulated = F.floor(F.sum("want").over(down) + 0.5)
    rounded = levels.filter(F.col("rank") > FOLDED).withColumn("upto", cumulated).withColumn("copies", (F.col("upto") - F.coalesce(F.lag("upto").over(down), F.lit(0))).cast("long"))
    first = levels.filter(F.col("rank") <= FOLDED).join(folded.withColumn("rank", F.col("at") + 1), ["skey", "rank"])
    return first.select("skey", "size", "n", F.col("folded").alias("copies")).unionByName(rounded.select("skey", "size", "n", "copies"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` (``size * copies``), one row for each row of ``docs``."""
    sized = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")).withColumn("skey", source_key(F.col("source"))))
    buckets = max(BUCKETS, -(-sized.count() // BUCKET_ROWS))
    rows = sized.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(buckets)).cast("int"))
    counts = cut(rows.groupBy("skey", "size", "bucket").agg(F.count(F.lit(1)).alias("m")))
    hist = cut(counts.groupBy("skey", "size").agg(F.sum("m").alias("n")))
    wanted = cut(targets(hist.groupBy("skey").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, cap))
    levels = cut(_level_copies(hist, cut(solve(hist, wanted, cap)), cap))
    before = Window.partitionBy("skey", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    plan = counts.withColumn("before", F.coalesce(F.sum("m").over(before), F.lit(0))).join(levels, ["skey", "size"]).join(wanted, "skey")
    own = Window.partitionBy("skey", "size", "bucket").orderBy(F.xxhash64(F.lit(seed + 1), F.col("doc_id")), "doc_id")
    ranked = rows.withColumn("rank", F.row_number().over(own)).join(plan, ["skey", "size", "bucket"])
    copies = F.expr("copies div n") + F.when(F.col("before") + F.col("rank") <= F.expr("copies % n"), 1).otherwise(0)
    return ranked.withColumn("of_doc", copies.cast("long")).select(
        "doc_id", "source", "size", "source_size", "target", F.col("of_doc").alias("copies"), (F.col("of_doc") * F.col("size")).alias("taken")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
