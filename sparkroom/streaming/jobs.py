"""File jobs on folders that files keep arriving in.

A file stream finds new files; each batch of them goes through a batch job, and the
job's rows (path, status, error) are kept in a manifest, a Parquet folder with a part for
each batch. A batch whose part is whole is not done again, though the stream asks for it
after a restart; one that was interrupted is, and its outputs, which have fixed names,
are replaced. So each file has one row and one output, however often the job stops.
Empty files are passed over, as Spark's file sources do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkroom.plans import convert

# Fixed value: the columns of Spark's binaryFile source.
BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"

#: A job takes files (path, content), a folder and outputs' names (path, name), and gives
#: path, status and error of each file.
Job = Callable[[DataFrame, str, DataFrame], DataFrame]


def arriving_files(spark: SparkSession, source: str, per_batch: int = 1000, glob: str = "*") -> DataFrame:
    """A stream of the files that appear below ``source``: path and content."""
    stream = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("maxFilesPerTrigger", per_batch)
    return stream.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(source).select("path", "content")


def fixed_names(files: DataFrame, root: str, suffix: str = ".tif") -> DataFrame:
    """path and name of each file's output: its path below ``root`` and a suffix more, so
    that a name depends on no other file."""
    plain = lambda c: F.regexp_replace(c, r"^([A-Za-z][A-Za-z0-9+.-]*):/+", r"$1:/")
    base = F.concat(F.rtrim(plain(F.lit(root)), F.lit("/")), F.lit("/"))
    below = F.when(F.startswith(plain("path"), base), F.substring(plain("path"), F.length(base) + 1, F.length("path"))).otherwise(F.regexp_extract("path", r"([^/]*)$", 1))
    return files.select("path", F.concat(below, F.lit(suffix)).alias("name"))


def _rendered(files: DataFrame, folder: str, names: DataFrame) -> DataFrame:
    return convert.convert(files, folder, names=names)


def _whole(part: str) -> bool:
    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(part)
    return store.get_file_info(f"{inside}/_SUCCESS").type != fs.FileType.NotFound


def batch_of(source: str, folder: str, manifest: str, job: Job = _rendered) -> Callable[[DataFrame, int], None]:
    """What is done with a batch and its number."""

    def one(batch: DataFrame, number: int) -> None:
        part = f"{manifest.rstrip('/')}/batch={number}"
        if not _whole(part):
            files = batch.select("path", "content")
            job(files, folder, fixed_names(files, source)).write.mode("overwrite").parquet(part)

    return one


def convert_arriving(spark: SparkSession, source: str, folder: str, manifest: str, checkpoint: str, per_batch: int = 1000, glob: str = "*", job: Job = _rendered, once: bool = True) -> StreamingQuery:
    """Start the job: with ``once`` on what has arrived, else until it is stopped.
    Folders are URIs that driver and executors share."""
    writer = arriving_files(spark, source, per_batch, glob).writeStream.foreachBatch(batch_of(source, folder, manifest, job)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def manifest_of(spark: SparkSession, manifest: str) -> DataFrame:
    """path, status, error and batch of all files so far."""
    return spark.read.schema("path string, status string, error string, batch int").parquet(manifest)


def arrival(ends: list[int]) -> Column:
    """The number of the run that did a row of the manifest, from 0: ``ends`` has the last
    batch that was there after each run (-1: none). A run may be any number of batches, as
    many as its files and ``per_batch`` ask."""
    return sum((F.when(F.col("batch") > end, 1).otherwise(0) for end in ends[:-1]), F.lit(0)).cast("int")


def last_batch(spark: SparkSession, manifest: str) -> int:
    """The last batch of the manifest, -1 if there is none."""
    last = manifest_of(spark, manifest).agg(F.max("batch")).first()[0]
    return -1 if last is None else last
