"""Shared helpers of the training-data operators: paths, hashing, null rules.

Rules that every operator follows unless its docstring says otherwise:

* a null text counts as the empty text;
* rows are never dropped, repeated rows are kept and treated alike;
* input columns that the operator does not read are ignored by the query
  functions and carried through unchanged by the pipeline stages;
* an empty table gives an empty result with the same columns.
"""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the contracts: space and the five ASCII controls 09 to 0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode, where one process is all there is."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="pagemill-shared-")
        spark.sparkContext.setCheckpointDir(at)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str, codec: str = "snappy") -> DataFrame:
    """Cut the lineage: write to a path of the shared folder and read back."""
    df.write.mode("overwrite").option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """``stored`` at a path of its own."""
    return stored(df, new_path(df.sparkSession, label), codec)


def removed(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of a few numbers each that may be broadcast: some 50 MB in memory.
BROADCAST_ROWS = 500_000


def sized(table: DataFrame) -> DataFrame:
    """A stored table of narrow rows, marked for broadcast if it has no more than BROADCAST_ROWS."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def even_join(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", hub: int = 1000) -> DataFrame:
    """rows join table on key without a hot task; table is stored, has each key once, and in ``n`` how many rows have it.

    Keys of more than ``hub`` rows are broadcast; the bound rises with the rows, so that
    they never are more than BROADCAST_ROWS. The result lacks ``n``.
    """
    total = table.agg(F.sum("n")).first()[0] or 0
    many = F.col("n") > max(hub, total // BROADCAST_ROWS)
    hubs = table.filter(many).drop("n")
    if hubs.isEmpty():
        return rows.join(table.drop("n"), key, how)
    names = F.broadcast(hubs.select(key))
    return rows.join(F.broadcast(hubs), key).unionByName(rows.join(names, key, "left_anti").join(table.filter(~many).drop("n"), key, how))


def doc_fold(doc_id: str | Column, parts: int) -> Column:
    """crc32(doc_id as text) mod parts; a null id counts as the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % F.lit(parts)


#: A group's rows in the order of their hashes are cut into stretches of a SLICES-th of what is wanted.
SLICES = 16


def least_hashed(rows: DataFrame, group: str, key: str, most: int, groups: int = 2000) -> DataFrame:
    """group, key: at most ``most`` distinct keys of each group, those with the least hash; ties by key.

    A hash is a place in its group, in stretches that hold ``most`` / SLICES keys on
    average. Stretches are counted; all keys of those below the one that the last key
    wanted falls into are taken, and only the keys of that one are ranked, so that no
    task sorts a group however large it is. Of more than ``groups`` groups the largest
    take part, which bounds what is broadcast: a row a group, SLICES * 4 counts at most.
    """
    spark = rows.sparkSession
    distinct = written(rows.select(group, key).distinct(), "least-keys")
    sizes = F.broadcast(distinct.groupBy(group).agg(F.count("*").alias("__n")).orderBy(F.col("__n").desc(), group).limit(groups))
    hashed = F.xxhash64(F.col(key))
    place = (hashed.cast("double") + F.lit(2.0**63)) / F.lit(2.0**64) * F.col("__n") * (SLICES / most)
    near = distinct.join(sizes, group).withColumn("__at", F.floor(place)).filter(F.col("__at") < 4 * SLICES).drop("__n")
    last, need = {}, {}
    for r in near.groupBy(group, "__at").agg(F.count("*").alias("n")).orderBy(group, "__at").collect():
        held = need.get(r[group], most)
        if held > 0:
            last[r[group]] = (r["__at"], held)
        need[r[group]] = held - r["n"]
    kind = rows.schema[group].dataType.simpleString()
    cuts = spark.createDataFrame([(g, int(at), int(n)) for g, (at, n) in last.items()], f"`{group}` {kind}, __last long, __need long")
    near = near.join(F.broadcast(cuts), group)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(hashed, key))
    edge = near.filter("__at = __last").withColumn("__rank", rank).filter("__rank <= __need")
    return near.filter("__at < __last").select(group, key).unionByName(edge.select(group, key))


#: The columns that stages read; any other is carried through.
BASE = ("doc_id", "text", "lang", "source", "n_chars")


def carried(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage (docs -> some rows of docs) safe from further columns whose names clash with its own."""

    @functools.wraps(stage)
    def run(docs: DataFrame, *args, **named) -> DataFrame:
        extra = [c for c in docs.columns if c not in BASE]
        if not extra:
            return stage(docs, *args, **named)
        packed = F.struct(*(F.col(f"`{c}`") for c in extra)).alias("__extra")
        out = stage(docs.select(*(c for c in docs.columns if c in BASE), packed), *args, **named)
        return out.select(*(F.col("__extra").getField(c).alias(c) if c in extra else F.col(c) for c in docs.columns))

    return run
