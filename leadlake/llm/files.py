"""Binary files that tasks write to and read from the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _place(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Writer:
    """A new file of a name of its own: a task that runs again leaves the first file alone.

    Readers learn of a file from the rows its task returned, so that a file of a
    lost task is never read.
    """

    def __init__(self, folder: str, suffix: str):
        system, path = _place(folder)
        system.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}{suffix}"
        self.uri, self.at = f"{folder.rstrip('/')}/{name}", 0
        self._stream = system.open_output_stream(f"{path.rstrip('/')}/{name}", compression=None)

    def write(self, data) -> None:
        self._stream.write(data)
        self.at += len(data)

    def close(self) -> None:
        self._stream.close()


def open_at(uri: str, offset: int):
    """A readable file, placed at ``offset``."""
    system, path = _place(uri)
    file = system.open_input_file(path)
    file.seek(offset)
    return file


def with_base(segments: DataFrame, size: str, name: str = "base") -> DataFrame:
    """``name``: the sum of ``size`` of all segments before, in the order of part and segment.

    Only one total per part meets in one task.
    """
    earlier = Window.unboundedPreceding, -1
    totals = segments.groupBy("part").agg(F.sum(size).alias("total"))
    parts = totals.select(F.col("part"), F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(*earlier)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum(size).over(Window.partitionBy("part").orderBy("segment").rowsBetween(*earlier)), F.lit(0))
    return segments.withColumn("inside", inside).join(parts, "part").withColumn(name, F.col("before") + F.col("inside")).drop("before", "inside")


#: Bytes of files that a reading task gets, where there are more segments than a few for each core.
READ_BYTES = 128 << 20


def dealt(segments: DataFrame) -> DataFrame:
    """Stored segments of files (part, segment, length, …) dealt out over the cluster in shares of equal bytes.

    Shares are runs of segments in their order. Their number is stated, so
    adaptive execution doesn't merge them, however small the table of segments is.
    """
    held = segments.agg(F.count("*").alias("n"), F.sum("length").alias("bytes")).first()
    if not held["n"]:
        return segments
    cores = segments.sparkSession.sparkContext.defaultParallelism
    tasks = min(held["n"], max(-(-held["bytes"] // READ_BYTES), 4 * cores))
    middle = F.col("begin_byte") + F.col("length") / 2
    share = F.least(F.floor(middle * tasks / held["bytes"]), F.lit(tasks - 1)).cast("int")
    placed = with_base(segments, "length", "begin_byte").withColumn("share", share)
    return placed.repartitionById(tasks, "share").select(*segments.columns)
