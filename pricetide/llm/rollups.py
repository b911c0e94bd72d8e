"""Token counts kept up to date by signed changes.

A batch of changes holds rows that add (+1) or take away (-1) a document's count under a source, language and tokenizer version; a revised count
is both.  A batch is summed before it is stored: it is written aside, claimed by a file that only one writer can create and that names what was
written, and put in place by one rename.  Who finds a claim without its batch finishes that rename, so a batch that is sent again, by whomever and
whenever, counts once.  Totals are the sum over all batches; `compact` lists the batches once, sums exactly these into one table and remembers them;
the next compaction deletes them.  Claims stay: they say which batches have ever been stored.

Defined results: null sources, languages and versions are groups of their own; null texts and counts count 0 tokens and one document; groups
whose documents and tokens are both 0 are left out of totals; repeated rows count each; an empty batch is stored as such.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP = ["source", "lang", "version"]
SCHEMA = "source string, lang string, version string, documents long, tokens long"


def changes(rows: DataFrame, sign: int, version: str, tokens: Column) -> DataFrame:
    """rows: source, lang.  One signed change for each."""
    n = F.coalesce(tokens, F.lit(0)).cast("long")
    return rows.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.lit(version).alias("version"), F.lit(sign).cast("long").alias("documents"), (n * sign).alias("tokens"))


def inserted(rows: DataFrame, version: str, tokens: Column) -> DataFrame:
    return changes(rows, 1, version, tokens)


def deleted(rows: DataFrame, version: str, tokens: Column) -> DataFrame:
    return changes(rows, -1, version, tokens)


def revised(rows: DataFrame, version: str, old: Column, new: Column) -> DataFrame:
    """Takes the old counts away and adds the new ones, under the same groups."""
    return changes(rows, -1, version, old).unionAll(changes(rows, 1, version, new))


class Rollup:
    """Totals below a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), at

    def _has(self, path: str) -> bool:
        fs, at = self._fs(path)
        return fs.exists(at)

    def _claimed(self, claim: str) -> str | None:
        """What a claim names; None without a claim, empty if its writer died before naming it."""
        fs, at = self._fs(claim)
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return "".join(chr(stream.readByte()) for _ in range(fs.getFileStatus(at).getLen()))
        finally:
            stream.close()

    def _place(self, staged: str, final: str, claim: str) -> bool:
        """Put what is staged in its place; False if another writer was first, whose rename is finished if need be."""
        fs, source = self._fs(staged)
        _, at = self._fs(claim)
        fs.mkdirs(at.getParent())
        first = fs.createNewFile(at)
        if first:
            stream = fs.create(at, True)
            stream.writeBytes(staged)
            stream.close()
        else:
            owner = self._claimed(claim)
            if not owner and not self._has(final):
                raise RuntimeError(f"{claim} was created and never named: delete it if its writer is gone")
            if owner:
                self._rename(owner, final)
        if first:
            self._rename(staged, final)
        elif fs.exists(source):
            fs.delete(source, True)
        return first

    def _rename(self, source: str, target: str) -> None:
        fs, a = self._fs(source)
        _, b = self._fs(target)
        fs.mkdirs(b.getParent())
        if fs.exists(a) and not fs.exists(b):
            fs.rename(a, b)

    def commit(self, batch: str, rows: DataFrame) -> bool:
        """Store a batch; False if it was stored before."""
        if not batch or "/" in batch:
            raise ValueError("a batch id is a name without slashes")
        final, claim = f"{self.path}/batches/{batch}", f"{self.path}/claims/{batch}"
        if owner := self._claimed(claim):
            if self._has(owner):
                self._rename(owner, final)
            return False
        staged = f"{self.path}/staged/{batch}-{uuid.uuid4().hex}"
        rows.groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).write.parquet(staged)
        return self._place(staged, final, claim)

    def _names(self, folder: str) -> list[str]:
        fs, at = self._fs(f"{self.path}/{folder}")
        return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []

    def _generation(self) -> str | None:
        return max(self._names("compacted"), default=None)

    def _merged(self, generation: str | None) -> set[str]:
        """Batches that a compacted table took in and that were not yet deleted then: those since the compaction before it."""
        if generation is None:
            return set()
        return {r[0] for r in self.spark.read.schema("batch string").parquet(f"{self.path}/compacted/{generation}/merged").collect()}

    def _sums(self, generation: str | None, batches: list[str]) -> DataFrame:
        parts = [f"{self.path}/compacted/{generation}/sums"] if generation else []
        parts += [f"{self.path}/batches/{b}" for b in batches]
        return self.spark.read.schema(SCHEMA).parquet(*parts) if parts else self.spark.createDataFrame([], SCHEMA)

    def _summed(self, rows: DataFrame) -> DataFrame:
        out = rows.groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return out.filter("documents <> 0 OR tokens <> 0")

    def _since(self, generation: str | None) -> list[str]:
        """Batches that a compacted table doesn't hold, in one listing."""
        names = self._names("batches")
        merged = self._merged(generation)
        return [b for b in names if b not in merged]

    def rows(self) -> DataFrame:
        """The stored sums that make up the totals."""
        generation = self._generation()
        return self._sums(generation, self._since(generation))

    def totals(self) -> DataFrame:
        return self._summed(self.rows())

    def compact(self) -> bool:
        """Sum all batches so far; a reader sees the old state or the new one.  False if another compaction was first."""
        generation = self._generation()
        new = self._since(generation)
        name = f"{int(generation or -1) + 1:08d}"
        staged = f"{self.path}/staged/compact-{name}-{uuid.uuid4().hex}"
        self._summed(self._sums(generation, new)).write.parquet(f"{staged}/sums")
        self.spark.createDataFrame([(b,) for b in new], "batch string").coalesce(1).write.parquet(f"{staged}/merged")
        if not self._place(staged, f"{self.path}/compacted/{name}", f"{self.path}/compacting/{name}"):
            return False
        # The generation before this one holds its batches: no reader needs them any more.
        for batch in self._merged(generation):
            fs, at = self._fs(f"{self.path}/batches/{batch}")
            fs.delete(at, True)
        return True


def replay(rollup: Rollup, batches: list[tuple[str, list[DataFrame]]]) -> list[bool]:
    """Commit batches in order; what each commit returned."""
    return [rollup.commit(name, reduce(DataFrame.unionAll, parts)) for name, parts in batches]
