"""Session settings the library relies on, and the folder it may write scratch tables to."""

from __future__ import annotations

import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

# Runtime settings only, so they can be applied to a session somebody else built.
# forceOptimizeSkewedJoin lets the runtime split a hot join key even where the split
# costs one more shuffle: a join on table_name is often followed by a grouping on
# (change_id, table_name, ...), which would otherwise keep the hot key in one task.
# The small minimum keeps all cores at work where few bytes carry much work, such as paths
# of files to parse; the runtime still merges down to one partition per core.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A task that reads an exchange of keys makes rows of texts and structs from them, many times as large, and
    # sorts them: with the default of 64 MB its memory grows with the input up to gigabytes.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Whether a side is small enough to broadcast is judged by its file size, which is
    # compressed; the sizes in memory are several times that.
    "spark.sql.sources.fileCompressionFactor": "4",
    # Source files differ in size by orders of magnitude, so a batch that goes to Python is
    # limited by its bytes and not only by its number of rows.
    "spark.sql.execution.arrow.maxBytesPerBatch": "67108864",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def apply_settings(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(app: str, cores: int = 8, **conf: str) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, else one below the warehouse.

    Both are taken to be places that every executor reaches; what their paths mean is not checked, so a cluster
    whose warehouse is a folder of the driver's machine needs ``spark.checkpoint.dir``.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return root.rstrip("/")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """A small DataFrame as a table of its own.

    The runtime splits a hot join key only where both sides of the join come straight from
    an exchange. A side that was just grouped by the join key does not; once stored, it does,
    and its size is known when the join is planned.
    """
    return Scratch(df.sparkSession, purpose).cut(df, "rows")


_OWNER: ContextVar[Owned | None] = ContextVar("owner of scratch folders", default=None)


class Owned:
    """All scratch folders that are made while it is open, by whatever function.

    Results that read them outlive the ``with``; :meth:`release` deletes the folders once the results have been stored.
    """

    def __init__(self):
        self.folders: list[Scratch] = []

    def __enter__(self) -> Owned:
        self._token = _OWNER.set(self)
        return self

    def __exit__(self, *failure) -> None:
        _OWNER.reset(self._token)
        outer = _OWNER.get()
        if outer is not None:
            outer.folders += self.folders

    def release(self) -> None:
        while self.folders:
            self.folders.pop().release()


class Scratch:
    """Tables written on the way to a result, under one new folder of the shared root.

    A written table cuts the lineage of an iterative job and survives the loss of any
    executor. The folder belongs to the result that reads it: drop it once that result
    has been stored, here or through the :class:`Owned` that was open when it was made.
    """

    def __init__(self, spark: SparkSession, purpose: str, **options: str):
        self.spark, self.options = spark, options
        self.root = f"{scratch_root(spark)}/{purpose}-{uuid.uuid4().hex}"
        owner = _OWNER.get()
        if owner is not None:
            owner.folders.append(self)

    def write(self, df: DataFrame, name: str) -> int:
        """Store ``df`` as ``name`` and return its row count, counted by the writing job."""
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.options(**self.options).parquet(f"{self.root}/{name}")
        return seen.get["rows"]

    def read(self, name: str, schema) -> DataFrame:
        """Read a table (or a folder of ``column=value`` tables) back with a known schema."""
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def release(self) -> None:
        """Delete the tables; results that read them can't be evaluated again."""
        self._delete(self.root)

    def drop(self, *names: str) -> None:
        """Delete some of the tables, as soon as no later step reads them."""
        for name in names:
            self._delete(f"{self.root}/{name}")

    def keep_only(self, *names: str) -> None:
        """Delete all tables but these: what a result reads stays, what led to it goes."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        system = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for entry in system.listStatus(root) if system.exists(root) else ():
            if entry.getPath().getName() not in names:
                system.delete(entry.getPath(), True)

    def _delete(self, path: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        self.write(df, name)
        return self.read(name, df.schema)


class Growing:
    """A table that grows by rows of new keys, stored in buckets of its keys, or of some of them (``by``).

    A join on the keys reads the buckets where they are: only the other side is exchanged, however much the
    table holds by then. Rows carry the ``step`` they were appended in; 32 steps share
    a folder, so that few folders have to be listed. The catalog knows the
    table as long as the context lasts, no longer; the files belong to the scratch folder.
    """

    def __init__(self, work: Scratch, name: str, keys: list[str], by: list[str] | None = None):
        self.spark, self.work, self.keys, self.by = work.spark, work, keys, by or keys
        self.path = f"{work.root}/{name}"
        self.table = f"growing_{uuid.uuid4().hex}"
        # As many buckets as an exchange has partitions, so that the other side fits as it is.
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.step = -1

    def append(self, df: DataFrame) -> int:
        """Store rows as the next step and return how many they are."""
        self.step += 1
        seen = Observation()
        rows = df.observe(seen, F.count(F.lit(1)).alias("rows"))
        rows = rows.withColumns({"step": F.lit(self.step), "_era": F.lit(self.step // 32)})
        writer = rows.write.mode("append").format("parquet").partitionBy("_era").bucketBy(self.buckets, *self.by)
        # Where the buckets are of some of the keys, a join on all of them is to read them where they are, too.
        every = "spark.sql.requireAllClusterKeysForCoPartition"
        before = self.spark.conf.get(every)
        self.spark.conf.set(every, self.by == self.keys)
        try:
            writer.options(**self.work.options).option("path", self.path).saveAsTable(self.table)
        finally:
            self.spark.conf.set(every, before)
        return seen.get["rows"]

    def all(self) -> DataFrame:
        return self.spark.table(self.table).drop("_era")

    def last(self) -> DataFrame:
        rows = self.spark.table(self.table)
        return rows.where((F.col("_era") == self.step // 32) & (F.col("step") == self.step)).drop("step", "_era")

    def files(self) -> DataFrame:
        """All rows, as files that no catalog has to know."""
        return self.spark.read.schema(self.spark.table(self.table).schema).parquet(self.path).drop("_era")

    def __enter__(self) -> Growing:
        return self

    def __exit__(self, *failure) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
