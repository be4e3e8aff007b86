"""The Hilbert curve as Spark expressions, in two forms that agree.

:func:`hilbert_key` and :func:`hilbert_cell` fold over the bits, a batch of rows at a time as arrays.
:func:`with_key` and :func:`with_cell` take four bits of both coordinates at a time by a table of the curve's four
orientations: eight look-ups in a row of projections, inside whole-stage code.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = 32


def _by_arrays(fold, returned: str, *columns: str | Column) -> Column:
    """``fold`` over batches of long columns as int64 arrays; rows with a null get null."""
    import pandas as pd

    def run(*series):
        some = ~pd.concat(series, axis=1).isna().any(axis=1).to_numpy()
        found = fold(*(s[some].to_numpy(np.int64) for s in series))
        if isinstance(found, dict):
            return pd.DataFrame({k: _spread(v, some) for k, v in found.items()})
        return _spread(found, some)

    def _spread(values, some):
        out = pd.Series(np.zeros(len(some), np.int64)).astype("Int64" if not some.all() else "int64")
        out[some] = values
        if not some.all():
            out[~some] = pd.NA
        return out

    return F.pandas_udf(run, returned)(*[c if isinstance(c, Column) else F.expr(f"cast({c} as bigint)") for c in columns])


def hilbert_key(x: str, y: str, levels: int = LEVELS) -> Column:
    """Position of the cell (x, y) on a curve of ``levels`` levels. Ids are below 2**31, so that with 32 levels the key fits a
    signed long; others raise."""

    def fold(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        d = np.zeros(len(x), np.int64)
        for i in range(levels - 1, -1, -1):
            side = (1 << i) - 1
            rx, ry = x >> i & 1, y >> i & 1
            x, y = x & side, y & side
            turned = side * rx
            x, y = np.where(ry == 0, y ^ turned, x), np.where(ry == 0, x ^ turned, y)
            d = d << 2 | (3 * rx ^ ry)
        return d

    fits = F.expr(f"({x}) >= 0 and ({y}) >= 0 and ({x}) < 2147483648 and ({y}) < 2147483648")
    checked = F.when(fits, F.expr(f"cast({x} as bigint)")).otherwise(F.raise_error(F.lit("ids must be from 0 to 2^31 - 1")))
    return _by_arrays(fold, "long", checked, y)


def hilbert_key_carried(x: str, y: str, levels: int = LEVELS) -> Column:
    """:func:`hilbert_key` with coordinates left as they are: the fold carries the orientation in place of turning them, as in
    the table (swapped 1, turned round 2). For ids below 2**31."""

    def fold(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        d, s = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for i in range(levels - 1, -1, -1):
            a, b = x >> i & 1, y >> i & 1
            crossed = (a ^ b) * (s & 1)
            px, py = a ^ crossed ^ s >> 1, b ^ crossed ^ s >> 1
            d = d << 2 | (3 * px ^ py)
            s = np.where(py == 0, s ^ (1 | px << 1), s)
        return d

    return _by_arrays(fold, "long", x, y)


def hilbert_cell(d: str, levels: int = LEVELS) -> Column:
    """``struct(x, y)`` of a position: the inverse of :func:`hilbert_key`."""

    def fold(d: np.ndarray) -> dict[str, np.ndarray]:
        x, y = np.zeros(len(d), np.int64), np.zeros(len(d), np.int64)
        for i in range(levels):
            rx = d >> 2 * i + 1 & 1
            ry = d >> 2 * i & 1 ^ rx
            side = (1 << i) - 1
            x, y = np.where(ry == 0, np.where(rx == 1, side - y, y), x), np.where(ry == 0, np.where(rx == 1, side - x, x), y)
            x, y = x + (rx << i), y + (ry << i)
        return {"x": x, "y": y}

    return _by_arrays(fold, "x long, y long", d)


@lru_cache(maxsize=2)
def _table(decode: bool) -> str:
    """An array as SQL, indexed by orientation and eight bits: of both coordinates, four each, or with ``decode`` of the key.
    Entries hold the other eight bits and, in the two lowest ones, the orientation that follows. An orientation says whether
    coordinates are swapped (1) and turned round (2)."""
    out = [0] * 1024
    for state in range(4):
        for bits in range(256):
            s, key = state, 0
            for level in (3, 2, 1, 0):
                a, b = bits >> 4 + level & 1, bits >> level & 1
                x, y = ((b, a) if s & 1 else (a, b)) if not s & 2 else ((1 - b, 1 - a) if s & 1 else (1 - a, 1 - b))
                key = key << 2 | 3 * x ^ y
                if y == 0:
                    s ^= 1 | x << 1
            out[state << 8 | (key if decode else bits)] = (bits if decode else key) << 2 | s
    return f"array({', '.join(map(str, out))})"


def _looked_up(df: DataFrame, decode: bool, levels: int, byte) -> tuple[DataFrame, list[str]]:
    """``df`` with eight columns more, the table's entries for ``byte(0)`` to ``byte(7)``, each by the orientation that the one
    before left; and their names. One projection each: an entry is used twice, so Spark keeps them apart."""
    table, before = F.expr(_table(decode)), F.lit(levels % 2)  # of 32 levels, two without bits change nothing
    names = [f"__hilbert_{t}" for t in range(8)]
    for t, name in enumerate(names):
        df = df.withColumn(name, table[before.bitwiseAND(3) * 256 + byte(t)])
        before = F.col(name)
    return df, names


def with_key(df: DataFrame, x: str = "src", y: str = "dst", out: str = "hilbert_key", levels: int = LEVELS) -> DataFrame:
    """``df`` with the position of the cell (x, y) on a curve of up to 32 levels; ids that :func:`hilbert_key` rejects raise."""
    fits = (F.col(x) >= 0) & (F.col(y) >= 0) & (F.col(x) < 1 << 31) & (F.col(y) < 1 << 31)
    checked = df.withColumn("__hilbert_x", F.when(fits, F.col(x)).otherwise(F.raise_error(F.lit("ids must be from 0 to 2^31 - 1"))).cast("long"))
    four = lambda c, t: F.shiftright(c, 28 - 4 * t).bitwiseAND(15)
    rows, names = _looked_up(checked, False, levels, lambda t: (four(F.col("__hilbert_x"), t) * 16 + four(F.col(y).cast("long"), t)).cast("int"))
    key = F.lit(0).cast("long")
    for t, name in enumerate(names):
        key = key.bitwiseOR(F.shiftleft(F.shiftright(name, 2).cast("long"), 56 - 8 * t))
    return rows.withColumn(out, key).drop(*names, "__hilbert_x")


def with_cell(df: DataFrame, key: str = "hilbert_key", x: str = "x", y: str = "y", levels: int = LEVELS) -> DataFrame:
    """``df`` with the cell at a position: the inverse of :func:`with_key`."""
    rows, names = _looked_up(df, True, levels, lambda t: F.shiftrightunsigned(key, 56 - 8 * t).bitwiseAND(255).cast("int"))
    cell = {}
    for c, low in ((x, 6), (y, 2)):
        cell[c] = F.lit(0).cast("long")
        for t, name in enumerate(names):
            cell[c] = cell[c].bitwiseOR(F.shiftleft(F.shiftright(name, low).bitwiseAND(15).cast("long"), 28 - 4 * t))
    return rows.withColumns(cell).drop(*names)


def hilbert_layout(e: DataFrame, parts: int) -> DataFrame:
    """Edges with their key, range-partitioned and sorted by it, so that Parquet's min/max skip by either endpoint."""
    keyed = with_key(e)
    return keyed.repartitionByRange(parts, "hilbert_key").sortWithinPartitions("hilbert_key")


def write_layout(e: DataFrame, path: str, parts: int) -> None:
    """The layout as Parquet: ``src, dst, hilbert_key``, in files that follow one another along the curve."""
    hilbert_layout(e.select("src", "dst"), parts).write.parquet(path)


def scan_layout(spark: SparkSession, path: str, src: tuple[int, int] | None = None, dst: tuple[int, int] | None = None) -> DataFrame:
    """Edges of a written layout, all or with either endpoint in a range, both ends included: Parquet skips what lies outside."""
    e = spark.read.parquet(path).select("src", "dst")
    for end, within in (("src", src), ("dst", dst)):
        if within is not None:
            e = e.filter(F.col(end).between(*within))
    return e


#: The four groups of bits that the prefix encoding keeps together, from the highest: lowest bit and number of bits, by name.
PREFIXES = {"high32": (16, 16), "next16": (8, 8), "next08": (4, 4), "last08": (0, 4)}


def with_prefixes(df: DataFrame, x: str = "src", y: str = "dst") -> DataFrame:
    """``df`` with the cell's bits by groups, those of x above those of y in each (see ``PREFIXES``)."""
    part = lambda c, low, bits: F.shiftright(F.col(c).cast("long"), low).bitwiseAND((1 << bits) - 1)
    return df.withColumns({n: F.shiftleft(part(x, low, bits), bits).bitwiseOR(part(y, low, bits)) for n, (low, bits) in PREFIXES.items()})


def without_prefixes(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """The cell put together again from the columns that :func:`with_prefixes` made, which go."""
    cell = {x: F.lit(0).cast("long"), y: F.lit(0).cast("long")}
    for n, (low, bits) in PREFIXES.items():
        cell[x] = cell[x].bitwiseOR(F.shiftleft(F.shiftright(n, bits), low))
        cell[y] = cell[y].bitwiseOR(F.shiftleft(F.col(n).bitwiseAND((1 << bits) - 1), low))
    return df.withColumns(cell).drop(*PREFIXES)


def hilbert_blocks(e: DataFrame, bits: int = 16) -> DataFrame:
    """Edges in each square block of side ``2 ** bits``."""
    return e.groupBy(F.shiftright("src", bits).alias("x_block"), F.shiftright("dst", bits).alias("y_block")).agg(F.count(F.lit(1)).alias("n"))
