"""The two tables of the store, url_lib and sem_info, as Parquet snapshots.

A change makes a new snapshot; readers of the old one are not disturbed. The
functions on DataFrames come first; ``Store`` keeps snapshots under a folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.functions.scalars import TARGETS, UNKNOWN

URL_LIB = (
    "id long, url string, is_target int, content_hash string, layout_hash string, extractor array<int>, "
    "last_access_ts timestamp, last_extract_ts timestamp, title string, content_type string"
)
SEM_INFO = "id long, url_id long, title string, start_time string, end_time string, place string, speaker string, description string"


def all_urls(url_lib: DataFrame) -> DataFrame:
    return url_lib.select("url")


def known(url_lib: DataFrame) -> DataFrame:
    """Ids with a decision other than unknown; none decided is not known."""
    return url_lib.filter(F.col("is_target") != UNKNOWN).select("id")


def non_targets(url_lib: DataFrame) -> DataFrame:
    """Unknown and no: what the store's question for targets in fact returns."""
    return url_lib.filter(F.col("is_target").isin(UNKNOWN, -1)).select("id")


def targets(url_lib: DataFrame) -> DataFrame:
    """Single and multiple: what it is meant to return."""
    return url_lib.filter(F.col("is_target").isin(*TARGETS)).select("id")


def by_id(url_lib: DataFrame, row_id: int) -> DataFrame:
    return url_lib.filter(F.col("id") == row_id).limit(1)


def by_url(url_lib: DataFrame, url: str) -> DataFrame:
    return url_lib.filter(F.col("url") == url).limit(1)


def lookup(url_lib: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the URLs in ``wanted``: one join instead of a question for each."""
    return url_lib.join(wanted.select("url").distinct(), "url", "left_semi").select(*url_lib.columns)


def revisits(url_lib: DataFrame, responses: DataFrame) -> DataFrame:
    """Responses of pages that are targets."""
    return responses.join(url_lib.filter(F.col("is_target").isin(*TARGETS)).select("url"), "url", "left_semi").select(*responses.columns)


def upserted(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``new`` rows in place of the ``old`` ones of the same key, the others as they are."""
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new, allowMissingColumns=True)


def updated(table: DataFrame, where: Column, **values: Column) -> DataFrame:
    return table.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def touched(url_lib: DataFrame, ids: DataFrame, column: str, now: Column | None = None) -> DataFrame:
    """``column`` (last_access_ts or last_extract_ts) set to now for the ids given."""
    marked = url_lib.join(ids.select(F.col("id").alias("__id")).distinct(), F.col("id") == F.col("__id"), "left")
    return updated(marked, F.col("__id").isNotNull(), **{column: F.current_timestamp() if now is None else now}).drop("__id")


def without(table: DataFrame, ids: DataFrame, key: str = "url_id") -> DataFrame:
    """Rows whose ``key`` is not among the ids."""
    return table.join(ids.select(F.col(ids.columns[0]).alias(key)), key, "left_anti").select(*table.columns)


#: Rows that one task numbers, about.
SLICE_ROWS = 1_000_000


def numbered(rows: DataFrame, start: int, by: str = "url", name: str = "id", within: str | None = None) -> DataFrame:
    """``rows`` with numbers from ``start`` + 1 without gaps, in the order of (md5 of ``by``, ``by``); ``within``: for each of its values.

    Slices by the leading digits of the hash are counted and numbered by themselves, so that
    no task sees all rows. There are as many digits as the rows ask for; the order, and so
    every number, is the same however many there are.
    """
    hashed = rows.withColumn("__hash", F.md5(F.coalesce(F.col(by).cast("string"), F.lit("")).cast("binary")))
    n, digits = rows.count(), 2
    while 16**digits * SLICE_ROWS < n and digits < 5:
        digits += 1
    group = [] if within is None else [within]
    sliced = hashed.withColumn("__slice", F.substring("__hash", 1, digits))
    sizes = sliced.groupBy(*group, "__slice").agg(F.count("*").alias("__n"))
    order = (Window.partitionBy(*group) if group else Window).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*group, "__slice", F.coalesce(F.sum("__n").over(order), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy(*group, "__slice").orderBy("__hash", by))
    # 16**digits rows for each group: broadcast while they are few.
    placed = sliced.withColumn("__own", own).join(F.broadcast(offsets) if digits < 4 and not group else offsets, [*group, "__slice"])
    placed = placed.withColumn(name, (F.lit(start) + F.col("__before") + F.col("__own")).cast("long"))
    return placed.select(*(c for c in rows.columns if c != name), name)


def stubs(new: DataFrame, largest: int) -> DataFrame:
    """Rows of url_lib for URLs seen first: undecided, no hashes, no extractor."""
    ids = numbered(new.select("url").distinct(), largest)
    empty = {"is_target": F.lit(UNKNOWN), "content_hash": F.lit(""), "layout_hash": F.lit(""), "extractor": F.array(F.lit(-1))}
    stamps = {c: F.lit(None).cast("timestamp") for c in ("last_access_ts", "last_extract_ts")}
    return ids.withColumns(empty | stamps | {"title": F.lit(None).cast("string"), "content_type": F.lit(None).cast("string")}).select(*(x.split()[0] for x in URL_LIB.split(", ")))


def record(values: dict[str, Column]) -> list[Column]:
    """Columns of a row of sem_info; a missing value is "", never null."""
    return [F.coalesce(v.cast("string"), F.lit("")).alias(c) for c, v in values.items()]


def results(sem_info: DataFrame, url_lib: DataFrame) -> DataFrame:
    """Every record with the URL of its page."""
    return sem_info.join(url_lib.select(F.col("id").alias("__id"), "url"), F.col("url_id") == F.col("__id")).drop("__id")


class Store:
    """Snapshots under ``root``; the last complete one counts. ``keep`` older ones stay for their readers.

    Tables that only grow are appended to in batches instead, each a folder of its own.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = 2):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep

    def _versions(self, name: str) -> list[int]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        done = lambda p: fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        return sorted(int(s.getPath().getName()[2:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("v=") and done(s.getPath()))

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        """The current snapshot; an empty table where there is none and ``schema`` is given."""
        found = self._versions(name)
        if not found:
            if schema is None:
                raise FileNotFoundError(f"{self.root}/{name}")
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.root}/{name}/v={found[-1]}")

    def write(self, name: str, df: DataFrame) -> DataFrame:
        found = self._versions(name)
        at = (found[-1] if found else 0) + 1
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/v={at}")
        for old in found[: -self.keep]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/v={old}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return self.spark.read.parquet(f"{self.root}/{name}/v={at}")

    def append(self, name: str, batch: int, df: DataFrame) -> None:
        """A batch of a table that only grows; one that is written again replaces itself."""
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch}")

    def batches(self, name: str, schema: str) -> DataFrame:
        """All batches of such a table, with the column batch."""
        fs, path = self._at(name)
        if not fs.exists(path) or not fs.listStatus(path):
            return self.spark.createDataFrame([], f"{schema}, batch long")
        return self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.root}/{name}")

    def batch_numbers(self, name: str) -> list[int]:
        """Numbers of the batches of such a table that are complete."""
        fs, path = self._at(name)
        done = lambda p: fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        return [int(s.getPath().getName()[6:]) for s in (fs.listStatus(path) if fs.exists(path) else []) if s.getPath().getName().startswith("batch=") and done(s.getPath())]

    def drop_batches(self, name: str, live: set[int]) -> None:
        """Remove all batches but the live ones."""
        fs, path = self._at(name)
        for s in fs.listStatus(path) if fs.exists(path) else []:
            own = s.getPath().getName()
            if own.startswith("batch=") and int(own[6:]) not in live:
                fs.delete(s.getPath(), True)

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def exists(self, name: str) -> bool:
        fs, path = self._at(name)
        return fs.exists(path)

    def reset(self) -> None:
        """Empty tables."""
        self.write("url_lib", self.spark.createDataFrame([], URL_LIB))
        self.write("sem_info", self.spark.createDataFrame([], SEM_INFO))
