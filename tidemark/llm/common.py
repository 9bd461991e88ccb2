"""Helpers shared by the operators: shared checkpoint folder, table reader, UTF-8 safe null handling."""

from __future__ import annotations

import contextlib
import contextvars
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut, shared_dir  # noqa: F401

#: White space between words, as the body of a regular expression class.
SPACE = r"\x20\x09-\x0D"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Tables that the innermost `scratch` removes when it ends.
_scratch: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scratch", default=None)


def cut_table(df: DataFrame) -> DataFrame:
    """Like cut, as a Parquet table in the shared folder: for frames that several later steps read by column."""
    path = f"{shared_dir(df.sparkSession)}/tidemark/{uuid.uuid4().hex}"
    if (own := _scratch.get()) is not None:
        own.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are cut inside are removed at the end, also after an error, but for those that are cut by the function that this gives.

    Only frames that read no other table of the inside may be used after it.
    """
    outer, own = _scratch.get(), []
    token = _scratch.set(own)

    def keep(df: DataFrame) -> DataFrame:
        back = _scratch.set(outer)
        try:
            return cut_table(df)
        finally:
            _scratch.reset(back)

    try:
        yield keep
    finally:
        _scratch.reset(token)
        for name in own:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_of(col: str | Column = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names, as Spark compares names; results then add their own."""
    own = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in own])


def shielded(docs: DataFrame, used: tuple[str, ...], f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """f of docs, in the columns that docs has: those that f doesn't use go by other names meanwhile, so none can clash."""
    names = {c: c if c in used else f"__own{i}" for i, c in enumerate(docs.columns)}
    out = f(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]))
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])


#: Frames of at most so many bytes may be broadcast.
BROADCAST_BYTES = 8 << 20


#: Tables of more rows are dealt out by key: Spark goes by the size of the files, and a table of 10 MB may be a relation of more than 100 MB on the driver.
DEALT = 1 << 15


def by_size(df: DataFrame, row_bytes: int, most: int | None = None) -> DataFrame:
    """df, marked for broadcast if its counted rows of about row_bytes bytes stay below a bound, BROADCAST_BYTES if none is given; else it's marked for a shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= (BROADCAST_BYTES if most is None else most) else df.hint("merge")


def dealt(table: DataFrame) -> DataFrame:
    """A written table, marked for a shuffle if it has many rows; of a small one Spark may broadcast either side of a join."""
    return table.hint("merge") if table.count() > DEALT else table
