"""Session defaults and the shared folder used for durable intermediates."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}


def build_session(app: str = "pricetide", cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session with the settings the jobs are written for.

    On a cluster the submitter owns the configuration; nothing below is
    required for correct results except a UTC session time zone.
    """
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        # Small local files: let every core get a share of the scan.
        .config("spark.sql.files.openCostInBytes", "131072")
        # The publisher's older exports are in a Java charset.
        .config("spark.sql.legacy.javaCharsets", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, taken from spark.checkpoint.dir.

    Only a local-mode session (tests, bench) may fall back to a temporary
    folder of its own; a cluster without the setting is refused, because a
    machine-local path would be lost with its executor.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(configured)
        return configured
    app = sc.applicationId
    if app not in _LOCAL_DIRS:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="pricetide-")
        sc.setCheckpointDir(os.path.join(_LOCAL_DIRS[app], "checkpoints"))
    return _LOCAL_DIRS[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; never reused between runs."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


#: Bytes of a Java method that HotSpot compiles at most; longer ones are interpreted.
_COMPILED = "8000"
_METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
_OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"


@contextlib.contextmanager
def compiled(spark: SparkSession, open_files: int = 0) -> Iterator[None]:
    """For what runs inside, operators whose generated method is too long for HotSpot run as several short ones.

    A task keeps up to ``open_files`` folders of a partitioned write open, and sorts its rows only where there are more.
    """
    held = {_METHOD_LIMIT: _COMPILED} | ({_OPEN_FILES: str(open_files)} if open_files else {})
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def stored(df: DataFrame, many_expressions: bool = False, compression: str | None = None) -> DataFrame:
    """The rows as a Parquet table below the shared folder: narrow on disk, read column by column, as often as needed.

    ``many_expressions``: the write runs :func:`compiled`.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "rows")
    with compiled(spark) if many_expressions else contextlib.nullcontext():
        df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def durable(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: fixes row placement and survives executor loss."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
