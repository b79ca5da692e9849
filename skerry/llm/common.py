"""What the operators share: written intermediate tables and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
THRESHOLD, UNCOUNTED = "spark.sql.autoBroadcastJoinThreshold", "256k"  # what Spark may broadcast by its own estimate, files' bytes, into written tables
_own: dict[str, str] = {}  # by application, where no folder is set
_made: ContextVar[tuple[list[str], ...]] = ContextVar("made", default=())


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Where none is set, a folder beside the warehouse, which a cluster
    shares too; only a single local JVM, as in tests, uses a temporary folder of its machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    app = spark.sparkContext.applicationId
    if app not in _own:
        local = spark.sparkContext.master.startswith("local[")
        _own[app] = f"file://{tempfile.mkdtemp(prefix='skerry-')}" if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/skerry-{app}"
    return _own[app]


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The session's setting has this value for what runs inside."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def write(df: DataFrame, name: str, keep: bool = False) -> str:
    """df as a table in the shared folder, whose path is returned. Spark may drop the shuffle files that led to it, and broadcasts little that isn't
    counted, as rows take several times their bytes in files. keep: the temporary() around the call leaves it alone; one around that one, if
    any, removes it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    off = spark.conf.get(THRESHOLD).startswith("-")
    with setting(spark, CLEANUP, "true"), setting(spark, THRESHOLD, "-1" if off else UNCOUNTED):
        df.write.parquet(path)
    around = _made.get()[: -1 if keep else None]
    if around:
        around[-1].append(path)
    return path


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df written and read back. It cuts the lineage and survives lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(write(df, name, keep))


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables written inside, in this thread, are removed at its end, failed or not, but for those to keep. What is kept must
    have been written by then."""
    made: list[str] = []
    token = _made.set((*_made.get(), made))
    try:
        yield
    finally:
        _made.reset(token)
        for path in made:
            remove(spark, path)


def tallied(df: DataFrame, name: str, keep: bool = False) -> tuple[DataFrame, int]:
    """written() and the number of rows, counted while they are written."""
    seen = Observation()
    table = written(df.observe(seen, F.count(F.lit(1)).alias("n")), name, keep)
    return table, seen.get["n"]


def free(name: str, columns: Iterable[str]) -> str:
    """The name with as many leading underscores as make it none of the columns'; Spark doesn't tell upper from lower case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join that shuffles both sides. Spark sizes rows that a function or an explode has made by the rows they were made from, so it may
    take a table of any size for one that is small enough to broadcast."""
    return df.hint("merge")


def broadcast_if(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Broadcast df only when its counted rows stay within the given bound; else the join shuffles both sides."""
    return F.broadcast(df) if rows <= most else shuffled(df)


MINIMA = 200_000  # broadcast rows of a node and its smallest neighbour
ROWS_A_TASK = 100_000  # links or minima


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """df over one task for each ROWS_A_TASK of its counted rows, where that is fewer than it has: a round over few links then isn't
    dealt over as many tasks and files as the corpus is."""
    return df.coalesce(max(1, -(-rows // ROWS_A_TASK)))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node each linked node reaches. Nodes without links aren't listed.

    Alternating large-star and small-star rounds over (u, v) links. Each star keeps a link from every neighbour to the
    smallest one, so the link count never grows, and minima are combined before the shuffle. Each round is a written table;
    rounds end when a round changes nothing, which takes about the logarithm of the longest path. Tasks follow the counted links, as there
    may be few in a corpus of many partitions. The minima are broadcast
    while they are few. Beyond that they are joined from a table of their own: a join of two plain scans is one whose large
    partitions Spark splits, so a star with very many links spreads over tasks.
    """

    def round_of(e: DataFrame, rows: int | None = None) -> tuple[DataFrame, tuple]:
        seen = Observation()
        e = written((e if rows is None else gathered(e, rows)).observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("all")), "links")
        return gathered(e, seen.get["n"]), (seen.get["n"], seen.get["all"])

    def to_least(e: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
        """Each node's smallest neighbour or itself, and the links with it."""
        least, n = tallied(gathered(e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), rows), "minima")
        return least, e.join(broadcast_if(least, n, MINIMA), "u")

    e = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e, state = round_of(e)
    while state[0]:
        _, met = to_least(e.union(e.select(F.col("v"), F.col("u"))), 2 * state[0])
        large = met.where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least, met = to_least(large, state[0])
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v")
        e, now = round_of(small.distinct(), state[0])
        if now == state:
            break
        state = now
    stars = written(gathered(e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node"), state[0]), "stars")
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
