"""Durable intermediates of iterative operators: tables in the shared folder, which survive the loss of executors."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pricetide.session import scratch_path


def unused(columns: list[str], name: str) -> str:
    """A column name that isn't among columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def settled(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again.

    A checkpoint would do for the rows, but keeps the optimiser's size estimates, which multiply at every join; in a loop they get so long
    that planning never ends.  A written table has its true size.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read any more."""
    for df in tables:
        if path := getattr(df, "_settled_at", None):
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
            df._settled_at = None
