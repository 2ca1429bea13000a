"""Incremental stages: each file or row is processed once, whatever restarts.

A file-source stream with a checkpoint takes the place of skip-if-exists; a run with
``availableNow`` takes what is new and ends. A batch that fails is taken again file by file, so
only the files that fail themselves are set apart, each with its error in ``quarantine``; with
``fail_fast`` the run stops there. A file gives all its rows or none.
"""

from __future__ import annotations

from collections.abc import Callable

from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annotary.functions.text import basename
from annotary.sources.files import escaped

_URI = "__file_uri"


def run_new(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    sink: str,
    checkpoint: str,
    step: Callable[[DataFrame], DataFrame],
    files_per_batch: int = 64,
    pattern: str = "*.parquet",
    quarantine: str | None = None,
    fail_fast: bool = False,
) -> int:
    """Apply ``step`` to the files that are new since the last run and append to ``sink``; returns the batches.

    Each batch is a folder of the sink named by its number, written over on a retry, so a batch
    that ran twice is there once; in it ``file`` is ``all`` or, after an error, each file's own.
    ``quarantine`` gets ``(source_file, error)``. ``source_file`` tells rows' files."""
    plain = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", pattern).parquet(source)
    uri = plain.metadataColumn("_metadata")["file_path"]
    rows = plain.withColumns({"source_file": basename(uri), _URI: uri})
    done = 0

    def write(part: DataFrame, to: str) -> None:
        step(part).write.option("compression", "zstd").mode("overwrite").parquet(to)

    def one(batch: DataFrame, number: int) -> None:
        nonlocal done
        to = f"{sink}/batch={number}"
        # what an earlier try of the batch left goes first
        at = spark._jvm.org.apache.hadoop.fs.Path(to)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        try:
            write(batch.drop(_URI), f"{to}/file=all")
        except Exception:
            if fail_fast or quarantine is None:
                raise
            for path in sorted(r[_URI] for r in batch.select(_URI).distinct().collect()):  # at most files_per_batch
                name = path.rsplit("/", 1)[-1]
                own_folder = f"file={quote(name, safe='')}"
                try:
                    own = spark.read.schema(schema).parquet(escaped(unquote(path))).withColumn("source_file", F.lit(name))
                    write(own, f"{to}/{own_folder}")
                except Exception as e:
                    error = spark.createDataFrame([(name, f"{type(e).__name__}: {e}"[:4000])], "source_file string, error string")
                    error.write.mode("overwrite").parquet(f"{quarantine}/batch={number}/{own_folder}")
        done += 1

    rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return done
