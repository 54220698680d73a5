"""What the operators of this subpackage share: the cluster's shared folder, tables written there, Arrow batches."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

#: UTF-8 bytes of text that one NumPy pass takes; longer documents form a pass of their own.
PASS_BYTES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="strandmill-"))
        named = spark.sparkContext.getCheckpointDir()
    return f"{named.rstrip('/')}/strandmill-{spark.sparkContext.applicationId}"


def _remove(jvm, jsc, path: str) -> None:
    try:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may be gone at exit
        pass


_registered: set[str] = set()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage is cut, and any executor can read it again.

    The tables of an application are removed when the driver's interpreter exits.
    """
    spark = df.sparkSession
    top = shared_folder(spark)
    if top not in _registered:
        _registered.add(top)
        atexit.register(_remove, spark.sparkContext._jvm, spark.sparkContext._jsc, top)
    path = f"{top}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Then:
    """What a task makes of each batch that an operator gives, so that the batch itself need not leave the task.

    ``schema`` may name the type of the operator's first column by that column's name in braces.
    """

    of: Callable[[pa.RecordBatch], pa.RecordBatch]
    schema: str


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, then: Then | None) -> DataFrame:
    """``df.mapInArrow(run, schema)``, or what ``then`` makes of it in the same worker."""
    if then is None:
        return df.mapInArrow(run, schema)
    name, kind = schema.split(",")[0].split()
    return df.mapInArrow(lambda batches: map(then.of, run(batches)), then.schema.format(**{name: kind}))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_passes(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PASS_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of the batches with at most ``limit`` bytes of text each (or one row), and their texts."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        begin = held = 0
        for i, size in enumerate(sizes):
            if i > begin and held + size > limit:
                part = batch.slice(begin, i - begin)
                yield part, part.column(column).to_pylist()
                begin, held = i, 0
            held += size
        part = batch.slice(begin)
        yield part, part.column(column).to_pylist()


class WordMemo:
    """What each word gives, kept for about ``limit`` words: when the young half is full, those not used since go."""

    def __init__(self, limit: int, many: Callable[[list[str]], list]):
        self.half, self.many, self.young, self.old = limit // 2, many, {}, {}

    def values(self, texts: list[list[str]]) -> list[list]:
        """For the words of each text what they give; ``many`` is asked once for all that is not kept."""
        if len(self.young) > self.half:
            self.old, self.young = self.young, {}
        young, old, every, lacking = self.young, self.old, set(), []
        every.update(*texts)
        for w in every:
            if w not in young:
                if (v := old.get(w)) is None:
                    lacking.append(w)
                else:
                    young[w] = v
        if lacking:
            young.update(zip(lacking, self.many(lacking)))
        return [list(map(young.__getitem__, words)) for words in texts]
