"""A worst-case-optimal multiway join, one variable at a time.

A prefix of bound variables is extended by one more. Each relation that holds the new variable says how many values it
would propose for the prefix; the one with the fewest proposes, the others validate. Any :class:`Relation` will do that can
count, propose and validate; :class:`Index` is the one made from a table.

An index keeps each key's sorted distinct values in one row, unless they are more than ``MAX_WIDTH``: such heavy keys, of which
there are few, keep rows ``key, value``. Prefixes whose keys are all light are extended by intersecting lists, one relation
after the other, so that only what is left of a list travels on. Prefixes with a heavy key are extended by rows: proposals by a
join with the chosen relation, validation by semi-joins on (key, value). Both kinds come out alike, decided a prefix.
Results stay factorised, ``prefix, values[]``, until expanded.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, hold

#: Values in one index row beyond which a key is heavy: 8 MB of ids.
MAX_WIDTH = 1 << 20
#: log2 of the values in a run and of the prefixes that repeat it at a time, and of both in a cell (:func:`extend_alike`).
RUN, TIMES, CELL_VALUES, CELL_PREFIXES = 8, 6, 10, 12


class Relation(Protocol):
    """What can extend prefixes. Columns whose names begin with two underscores are the join's own."""

    def count(self, prefixes: DataFrame, key: str | None, out: str) -> DataFrame:
        """``prefixes`` with ``out``, how many values it would propose; prefixes without any may go."""

    def propose(self, prefixes: DataFrame, key: str | None, new: str) -> DataFrame:
        """A row for each prefix and value, the value as column ``new``."""

    def validate(self, found: DataFrame, key: str | None, new: str) -> DataFrame:
        """The rows whose value ``new`` it allows."""


@dataclass
class Index:
    """``lists``: ``key, vs, n``, each light key's sorted distinct values and their number. ``heavy``: the distinct ``key, value``
    rows of the others, None if there are none."""

    lists: DataFrame
    heavy: DataFrame | None = None
    heavy_sizes: DataFrame | None = None

    @property
    def sizes(self) -> DataFrame:
        """``key, n``."""
        own = self.lists.select("key", "n")
        return own if self.heavy is None else own.unionAll(self.heavy_sizes)

    @property
    def rows(self) -> DataFrame:
        """The distinct ``key, value`` pairs."""
        own = self.lists.select("key", F.explode("vs").alias("value"))
        return own if self.heavy is None else own.unionAll(self.heavy)

    def edges(self) -> int:
        """The number of :attr:`rows`."""
        return self.sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def count(self, prefixes: DataFrame, key: str, out: str) -> DataFrame:
        own = self.sizes.select(F.col("key").alias("__k"), F.col("n").alias(out))
        return prefixes.join(own, F.col(key) == F.col("__k")).drop("__k")

    def propose(self, prefixes: DataFrame, key: str, new: str) -> DataFrame:
        own = self.lists.select(F.col("key").alias("__k"), F.col("vs").alias("__vs"))
        found = prefixes.join(own, F.col(key) == F.col("__k")).select(*prefixes.columns, F.explode("__vs").alias(new))
        if self.heavy is None:
            return found
        rows = self.heavy.select(F.col("key").alias("__k"), F.col("value").alias(new))
        return found.unionByName(prefixes.join(rows, F.col(key) == F.col("__k")).drop("__k"))

    def validate(self, found: DataFrame, key: str, new: str) -> DataFrame:
        rows = self.rows.select(F.col("key").alias("__k"), F.col("value").alias("__v"))
        return found.join(rows, (F.col(key) == F.col("__k")) & (F.col(new) == F.col("__v")), "left_semi")


def build_index(df: DataFrame, key: str, value: str, persist: bool = True, unique: bool = False, max_width: int | None = None) -> Index:
    """An index of ``df`` on ``key``. Any orderable types do; duplicate pairs count once, and with ``unique`` there are none.

    Rows are counted by key first, with partial counts, so a key of more than ``max_width`` rows (at most one for so many rows
    of the table; their names are broadcast) never has them gathered. All others need one exchange."""
    width = MAX_WIDTH if max_width is None else max_width
    rows = df.select(F.col(key).alias("key"), F.col(value).alias("value")).filter("key is not null and value is not null")
    wide = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > width).select("key"))
    some = not wide.isEmpty()
    light = rows.join(F.broadcast(wide), "key", "left_anti") if some else rows
    gather = F.collect_list if unique else F.collect_set
    lists = light.groupBy("key").agg(F.array_sort(gather("value")).alias("vs")).withColumn("n", F.size("vs").cast("long"))
    lists = hold(lists) if persist else lists
    if not some:
        return Index(lists)
    heavy = rows.join(F.broadcast(wide), "key", "left_semi")
    heavy = cut(heavy if unique else heavy.distinct())
    return Index(lists, heavy, cut(heavy.groupBy("key").agg(F.count(F.lit(1)).alias("n"))))


def keep_bucketed(index: Index, name: str, path: str, buckets: int) -> Index:
    """The index with its lists written once as the table ``name`` at ``path``, bucketed and sorted by key: whatever joins it by key
    later moves only its own rows. The sizes are a narrow table beside it. Heavy keys keep their rows."""
    spark = index.lists.sparkSession
    for table, rows in ((name, lambda: index.lists), (f"{name}_sizes", lambda: spark.table(name).select("key", "n"))):
        rows().write.bucketBy(buckets, "key").sortBy("key").option("path", f"{path}/{table}").saveAsTable(table)
    return BucketedIndex(spark.table(name), index.heavy, index.heavy_sizes, spark.table(f"{name}_sizes"))


@dataclass
class BucketedIndex(Index):
    widths: DataFrame | None = None

    @property
    def sizes(self) -> DataFrame:
        return self.widths if self.heavy is None else self.widths.unionAll(self.heavy_sizes)


def index_of_lists(lists: DataFrame) -> Index:
    """An index of ``key, vs`` whose lists are sorted and distinct, each key once, as part files keep them (see
    ``codecs.read_packed_lists``): nothing is grouped."""
    return Index(hold(lists.select("key", "vs", F.size("vs").cast("long").alias("n")).filter("n > 0")))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """The un-keyed index: the column's distinct values ``v``."""
    return df.select(F.col(column).alias("v")).distinct()


@dataclass
class Unkeyed:
    """A relation without a key: it proposes all its ``values`` (``value``) for every prefix, so their number is one constant,
    and allows those only. They are never gathered into a list. A prefix meets all of them only where it has no relation
    that proposes fewer."""

    values: DataFrame

    def count(self, prefixes: DataFrame, key: None, out: str) -> DataFrame:
        n = self.values.count()
        return prefixes.withColumn(out, F.lit(n).cast("long")) if n else prefixes.limit(0).withColumn(out, F.lit(0).cast("long"))

    def propose(self, prefixes: DataFrame, key: None, new: str) -> DataFrame:
        return prefixes.crossJoin(self.values.select(F.col("value").alias(new)))

    def validate(self, found: DataFrame, key: None, new: str) -> DataFrame:
        return found.join(self.values.select(F.col("value").alias("__v")), F.col(new) == F.col("__v"), "left_semi")


def build_unkeyed(df: DataFrame, column: str) -> Unkeyed:
    return Unkeyed(hold(distinct_values(df, column).filter("v is not null").withColumnRenamed("v", "value")))


@dataclass
class Between:
    """A computed relation: from a prefix's column it allows the integers from ``low(column)`` to ``high(column)``, both
    included. Nothing is stored or joined."""

    low: object
    high: object

    def _ends(self, key: str) -> tuple[Column, Column]:
        return self.low(F.col(key)).cast("long"), self.high(F.col(key)).cast("long")

    def count(self, prefixes: DataFrame, key: str, out: str) -> DataFrame:
        low, high = self._ends(key)
        return prefixes.withColumn(out, F.greatest(high - low + 1, F.lit(0).cast("long"))).filter(F.col(out) > 0)

    def propose(self, prefixes: DataFrame, key: str, new: str) -> DataFrame:
        low, high = self._ends(key)
        return prefixes.filter(low <= high).withColumn(new, F.explode(F.sequence(low, high)))

    def validate(self, found: DataFrame, key: str, new: str) -> DataFrame:
        low, high = self._ends(key)
        return found.filter(F.col(new).between(low, high))


@dataclass
class Congruent:
    """A computed relation that only narrows: values of the same remainder by ``modulus`` as a prefix's column. It has no
    values of its own to propose, so another relation must."""

    modulus: int

    def count(self, prefixes: DataFrame, key: str, out: str) -> DataFrame:
        return prefixes.withColumn(out, F.lit((1 << 63) - 1).cast("long"))

    def propose(self, prefixes: DataFrame, key: str, new: str) -> DataFrame:
        return prefixes.limit(0).withColumn(new, F.lit(None).cast("long"))

    def validate(self, found: DataFrame, key: str, new: str) -> DataFrame:
        return found.filter(F.pmod(F.col(new), F.lit(self.modulus)) == F.pmod(F.col(key), F.lit(self.modulus)))


def index_join(probe: DataFrame, index: Index, key: str) -> DataFrame:
    """Each probe row with the list of its key, of light keys; rows whose key the index lacks go."""
    return probe.join(index.lists.withColumnRenamed("key", "__key"), F.col(key) == F.col("__key")).drop("__key")


@dataclass
class Atom:
    """A relation that constrains the new variable, and the prefix column that is its key; None if un-keyed."""

    index: Relation
    key: str | None


def cheapest(counts: list[Column]) -> Column:
    """``struct(n, rel)`` of the fewest proposals; of equal counts the first relation's."""
    return F.array_min(F.array(*[F.struct(c.alias("n"), F.lit(i).alias("rel")) for i, c in enumerate(counts)]))


def propose(prefixes: DataFrame, atoms: list[Atom]) -> DataFrame:
    """Each prefix with ``rel`` and ``n``, the relation that proposes fewest values and how many."""
    counted = prefixes
    for i, atom in enumerate(atoms):
        counted = atom.index.count(counted, atom.key, f"__n{i}")
    best = counted.withColumn("__best", cheapest([F.col(f"__n{i}") for i in range(len(atoms))]))
    return best.select(*prefixes.columns, F.col("__best.rel").alias("rel"), F.col("__best.n").alias("n"))


def intersect_lists(rows: DataFrame, held: str, index: Index, key: str) -> DataFrame:
    """``rows`` whose list ``held`` is narrowed to the values that ``index`` has for ``key``; rows left without any go."""
    own = index.lists.select(F.col("key").alias("__k"), F.col("vs").alias("__vs"), F.col("n").alias("__n"))
    joined = rows.join(own, F.col(key) == F.col("__k"))
    shorter = F.size(held) <= F.col("__n")  # the shorter list goes first, as its order stays
    both = F.array_intersect(F.when(shorter, F.col(held)).otherwise(F.col("__vs")), F.when(shorter, F.col("__vs")).otherwise(F.col(held)))
    return joined.withColumn(held, both).filter(F.size(held) > 0).drop("__k", "__vs", "__n")


def _extend_lists(prefixes: DataFrame, atoms: list[Atom], new: str) -> DataFrame:
    """By lists: prefixes with a key that has none, heavy ones too, go."""
    first = atoms[0].index.lists.select(F.col("key").alias("__k"), F.col("vs").alias(new))
    found = prefixes.join(first, F.col(atoms[0].key) == F.col("__k")).drop("__k")
    for atom in atoms[1:]:
        found = intersect_lists(found, new, atom.index, atom.key)
    return found


def _extend_rows(prefixes: DataFrame, atoms: list[Atom], new: str) -> DataFrame:
    """By rows, for any relations: what each prefix's cheapest one proposes and all others allow. The choice is made once and
    cut from its lineage, so a relation's branch holds its own join only."""
    chosen = cut(propose(prefixes, atoms).drop("n"))
    out = None
    for i, atom in enumerate(atoms):
        found = atom.index.propose(chosen.filter(F.col("rel") == i), atom.key, new)
        for other in (o for o in atoms if o is not atom):  # the proposer's own values need no validation
            found = other.index.validate(found, other.key, new)
        out = found if out is None else out.unionByName(found)
    return out.drop("rel")


def _with_heavy_key(prefixes: DataFrame, atoms: list[Atom]) -> DataFrame:
    """The prefixes of which a key is heavy; such keys are few."""
    flagged, flags = prefixes, []
    for i, atom in enumerate(atoms):
        if atom.index.heavy is not None:
            keys = atom.index.heavy_sizes.select(F.col("key").alias(f"__h{i}"))
            flagged = flagged.join(F.broadcast(keys), F.col(atom.key) == F.col(f"__h{i}"), "left")
            flags.append(f"__h{i}")
    return flagged.filter(F.coalesce(*flags).isNotNull() if len({a.index.heavy_sizes.schema["key"].dataType for a in atoms if a.index.heavy is not None}) == 1 else F.greatest(*[F.col(f).isNotNull() for f in flags], F.lit(False))).drop(*flags)


def _narrowed(atoms: list[Atom]) -> list[Atom]:
    """Un-keyed relations allow the same values for every prefix: they narrow an index once, where there is one, and go."""
    at = next((i for i, a in enumerate(atoms) if isinstance(a.index, Index)), None)
    free = [a.index for a in atoms if isinstance(a.index, Unkeyed)]
    if at is None or not free:
        return atoms
    rows = atoms[at].index.rows
    for relation in free:
        rows = relation.validate(rows, None, "value")
    own = Atom(build_index(rows, "key", "value", unique=True), atoms[at].key)
    return [own if i == at else a for i, a in enumerate(atoms) if not isinstance(a.index, Unkeyed)]


def extend(prefixes: DataFrame, atoms: list[Atom], new: str, expand: bool = True, form: str = "auto") -> DataFrame:
    """``prefixes`` with one more variable ``new`` that every atom allows. ``expand=False`` leaves it factorised: an array
    column ``new``, never empty, a prefix in one row unless one of its keys is heavy. ``form``: ``rows`` for all prefixes, or
    by lists where every key of a prefix is light (``auto``); relations that aren't indices are used by rows."""
    atoms = atoms if form == "rows" else _narrowed(atoms)
    by_rows = form == "rows" or not all(isinstance(a.index, Index) for a in atoms)
    heavy = not by_rows and any(a.index.heavy is not None for a in atoms)
    if heavy:
        prefixes = cut(prefixes)  # read by both branches
    if by_rows or heavy:
        wide = _extend_rows(prefixes if by_rows else _with_heavy_key(prefixes, atoms), atoms, new)
        if not expand:
            wide = _chunked(wide, prefixes.columns, new)
        if by_rows:
            return wide
    found = _extend_lists(prefixes, atoms, new)
    found = expand_values(found, new) if expand else found.select(*prefixes.columns, new)
    return found.unionByName(wide) if heavy else found


def _packs(rows: DataFrame, of: Column, width: int, cell: int) -> DataFrame:
    """``of, block, low, high, xs``: rows in order within their class, 2^width at most to a sorted list ``xs`` of structs, 2^cell
    to a block; ``low`` and ``high`` are its ends by the first column. No task sorts or gathers a class."""
    placed = rows.select(of.alias("of"), F.struct(*rows.columns).alias("x")).repartitionByRange("of", "x").sortWithinPartitions("of", "x")
    numbered = placed.withColumn("at", F.shiftright(F.monotonically_increasing_id(), width))
    lists = numbered.groupBy("of", "at").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    first = rows.columns[0]
    return lists.select("of", F.shiftright("at", cell - width).alias("block"), F.col("xs")[0][first].alias("low"), F.element_at("xs", -1)[first].alias("high"), "xs")


def extend_alike(prefixes: DataFrame, key: str, values: DataFrame, of: Callable[[Column], Column], new: str) -> DataFrame:
    """``prefixes`` with each of the ``values`` (``v``) that is smaller than their ``key`` and of the same class, ``of``, as ``new``:
    an un-keyed relation narrowed by computed ones.

    The result is quadratic in a class, so it is made in cells of so many prefixes and values, as many to a class as it needs. In
    a cell some prefixes, one after the other, repeat the same run of values. So neighbouring rows are alike, and a columnar
    file holds them in a fraction of a byte each."""
    left = hold(_packs(prefixes.select(key, *(c for c in prefixes.columns if c != key)), of(F.col(key)), TIMES, CELL_PREFIXES))
    right = hold(_packs(values.select("v"), of(F.col("v")), RUN, CELL_VALUES))
    # which blocks there are: a row for each, a thousandth of the rows and less
    a = left.groupBy("of", F.col("block").alias("__l")).agg(F.max("high").alias("__high"))
    b = right.groupBy("of", F.col("block").alias("__r")).agg(F.min("low").alias("__low"))
    cells = a.join(F.broadcast(b), "of").filter("__low < __high").count()
    n = max(1, min(cells, int(prefixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))), cells // 8)
    cell = ["of", "__l", "__r"]
    packs = left.withColumnRenamed("block", "__l").join(F.broadcast(b), "of").filter("__low < high").select(*cell, "xs")
    runs = right.withColumnRenamed("block", "__r").join(F.broadcast(a), "of").filter("low < __high").select(*cell, "low", F.col("xs.v").alias("vs"))
    # by merging, packs come one by one and meet the few runs of their cell
    met = packs.repartition(n, *cell).join(runs.repartition(n, *cell).hint("merge"), cell)
    each = met.select("low", "vs", F.explode("xs").alias("x")).filter(F.col("low") < F.col(f"x.{key}"))
    return each.select(*[F.col(f"x.{c}").alias(c) for c in prefixes.columns], F.explode("vs").alias(new)).filter(F.col(new) < F.col(key))


def _chunked(rows: DataFrame, columns: list[str], new: str) -> DataFrame:
    """Values as lists of bounded width: those of a prefix by remainders of a hash, as many as keep lists under ``MAX_WIDTH``."""
    sized = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n"))
    if sized.filter(F.col("__n") > MAX_WIDTH).isEmpty():
        return rows.groupBy(*columns).agg(F.collect_list(new).alias(new))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns]
    counts = sized.select(*[F.col(c).alias(f"__{c}") for c in columns], F.ceil(F.col("__n") * 2 / MAX_WIDTH).alias("__parts"))
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    dealt = rows.join(counts, condition).withColumn("__part", F.pmod(F.xxhash64(new), F.col("__parts")))
    return dealt.groupBy(*columns, "__part").agg(F.collect_list(new).alias(new)).drop("__part")


def expand_values(df: DataFrame, column: str) -> DataFrame:
    """A factorised column flattened; empty lists give no rows."""
    return df.select(*[c for c in df.columns if c != column], F.explode(column).alias(column))
