"""Cutting lineage and choosing physical joins on checked sizes."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of a side that may be broadcast; the callers' rows are under 200 bytes, so 40 MB at most.
BROADCAST_ROWS = 200_000


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write `df` to the shared checkpoint folder and read it back with no lineage.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a local
    session with no such setting (a test on one machine) gets a temporary one; on a cluster its absence is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="larkspur-"))
    return df.checkpoint(eager)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark `df` for broadcast if it has at most `limit` rows by count; otherwise leave the join to shuffle."""
    return F.broadcast(df) if rows <= limit else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def salted_rank(df: DataFrame, keys: list[str], order: list[str], out: str, salts: int = 64) -> DataFrame:
    """A 0-based rank `out` within `keys`, without putting a whole key into one task.

    Each key is cut into `salts` pieces by the hash of `order` (its columns must tell rows
    apart). Rows are numbered inside a piece, and the piece's start is the sum of the pieces
    before it: a table of at most keys x salts rows. The order is arbitrary but repeatable.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))

    local = F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order)) - 1
    sizes = salted.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = salted.withColumn("_local", local)
    joined = numbered.join(starts, [*keys, "_salt"])
    return joined.withColumn(out, (F.col("_start") + F.col("_local")).cast("long")).drop("_salt", "_local", "_start")


def running_start(df: DataFrame, keys: list[str], piece: str, order: list[str], measure: str, out: str) -> DataFrame:
    """The sum `out` of `measure` over the rows before a row of its `keys`, in the order of (`piece`, `order`).

    `piece` is a column that never decreases along the order; only rows of one piece meet in a task.
    The pieces' starts are a running sum over a table of keys x pieces.
    """
    inside = Window.partitionBy(*keys, piece).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy(*keys, piece).agg(F.sum(measure).alias("_sum"))
    starts = sizes.select(*keys, piece, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    local = df.withColumn("_local", F.coalesce(F.sum(measure).over(inside), F.lit(0)))
    return local.join(starts, [*keys, piece]).withColumn(out, (F.col("_start") + F.col("_local")).cast("long")).drop("_start", "_local")


def running_max(df: DataFrame, keys: list[str], piece: str, order: list[str], measure: str, out: str) -> DataFrame:
    """The largest `measure` of the rows up to and with a row of its `keys`, in the order of (`piece`, `order`); only rows of one piece meet in a task."""
    inside = Window.partitionBy(*keys, piece).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    tops = df.groupBy(*keys, piece).agg(F.max(measure).alias("_top"))
    earlier = tops.select(*keys, piece, F.max("_top").over(before).alias("_earlier"))
    local = df.withColumn("_local", F.max(measure).over(inside))
    return local.join(earlier, [*keys, piece]).withColumn(out, F.greatest("_local", "_earlier")).drop("_local", "_earlier")


def _plain(rows: pd.DataFrame) -> pd.DataFrame:
    """Text columns as objects: joined frames hold them in chunks, which cannot be handed back."""
    return rows.astype({c: object for c, t in rows.dtypes.items() if isinstance(t, (pd.StringDtype, pd.ArrowDtype))})


def grouped(df: DataFrame, keys: list[str], fold: Callable[[pd.DataFrame], pd.DataFrame], schema: str | StructType) -> DataFrame:
    """`fold` on the rows of each key, streamed: rows are sorted by key within partitions, and a key's rows are passed on when the next key begins.

    One Python call handles many small keys of a batch, which a grouped map pays for one by one.
    """

    def same(a: pd.Series, b: pd.Series) -> bool:
        return all(x == y or (pd.isna(x) and pd.isna(y)) for x, y in zip(a, b))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the stretches of the key that is not over; each is copied once, when it is
        for batch in batches:
            if not len(batch):
                continue
            change = pd.Series(False, index=batch.index)
            for k in keys:
                change |= batch[k].ne(batch[k].shift()) & ~(batch[k].isna() & batch[k].shift().isna())
            starts = sorted({0, *change.to_numpy().nonzero()[0].tolist()})
            done = []
            for a, b in zip(starts, [*starts[1:], len(batch)]):
                piece = batch.iloc[a:b]
                if held and not same(held[-1][keys].iloc[-1], piece[keys].iloc[0]):
                    done.append(fold(pd.concat(held, ignore_index=True)))
                    held = []
                held.append(piece)
            if done:
                yield _plain(pd.concat(done, ignore_index=True))
        if held:
            yield _plain(fold(pd.concat(held, ignore_index=True)))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def streamed(df: DataFrame, key: str, order: list[str], start: Callable[[], Any], fold: Callable[[pd.DataFrame, Any], pd.DataFrame], schema: str) -> DataFrame:
    """`fold` on the rows of each key in `order`, stretch by stretch, with one state per key that `start` makes and `fold` changes.

    For folds over a history of any length: a task holds a batch of rows and a state. A key is one task, as its state passes from row to row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            if not len(batch):
                continue
            changes = batch[key].ne(batch[key].shift()).to_numpy().nonzero()[0].tolist()
            done = []
            for a, b in zip(changes, [*changes[1:], len(batch)]):
                rows = batch.iloc[a:b].reset_index(drop=True)
                if state is None or rows[key].iloc[0] != current:
                    current, state = rows[key].iloc[0], start()
                done.append(fold(rows, state))
            yield _plain(pd.concat(done, ignore_index=True))

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)
