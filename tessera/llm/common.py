"""What the operators share: the tables, the separators of words and the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters between words, as Spark's trim and Java's expressions take them.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("*",)))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text that isn't null, in order."""
    trimmed = F.trim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; where it is unset (tests, one machine) a temporary one is set."""
    if not (folder := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str, replaces: DataFrame | None = None) -> DataFrame:
    """The rows, written as a table in the shared folder and read again: a lost executor costs a file's tasks, not the lineage before them. The folder goes when the session ends, or when a later table ``replaces`` it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    if replaces is not None:
        discard(replaces)
    return out


def discard(table: DataFrame) -> None:
    """Deletes the folder of a ``written`` table that nothing reads any more."""
    spark = table.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(table.written_at)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows with their partitions as they are, in the shared folder; the files go when the session ends."""
    spark = df.sparkSession
    shared_folder(spark)
    out = df.checkpoint(eager=True)
    place = checkpoint_of(out)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return out


def checkpoint_of(table: DataFrame):
    """The folder of a ``checkpointed`` table, as a path of the JVM."""
    return table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._jdf.queryExecution().logical().rdd().getCheckpointFile().get())


def unused(taken: list[str], *wanted: str) -> list[str]:
    """The names, each with as many underscores as it takes to differ (in any case of letters) from the columns that there are."""
    there, out = {n.lower() for n in taken}, []
    for name in wanted:
        while name.lower() in there:
            name += "_"
        there.add(name.lower())
        out.append(name)
    return out
