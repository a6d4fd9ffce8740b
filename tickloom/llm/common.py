"""What the operators of this subpackage share: checkpoints in the shared folder, stable hashes, word arrays."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

U64 = np.uint64
#: Odd multipliers of the 64-bit finalizer (splitmix64) and of the word polynomial.
MIX_A, MIX_B, GOLDEN = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)
POLY = U64(0xD6E8FEB86659FD93)
#: ASCII white space, as in the class [\x20\x09-\x0D].
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text handled at once by the array kernels: their arrays then fit in a core's cache.
CHUNK_BYTES = 1 << 18
#: A key is hot if it holds more than one in this many of the rows, and more than HOT_ROWS; so there are at most that many hot keys.
HOT_KEYS, HOT_ROWS = 10_000, 256


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, set as the session's checkpoint folder.

    Where that is unset, a local session gets a temporary folder; any other session must set it,
    since a folder of one machine is not seen by the others.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tickloom-checkpoints-")
        sc.setCheckpointDir(folder)
    return spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().get()


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of df by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release_memory() -> None:
    """Give memory that a task has freed back to the system; workers are reused, and executors count all they hold."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def named(column: str) -> Column:
    """The column of that very name, whatever characters it has."""
    return F.col("`" + column.replace("`", "``") + "`")


def without(df: DataFrame, *names: str) -> list[str]:
    """Columns of df but for names; as in Spark, case makes no difference."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def map_rows(df: DataFrame, kept: list[str], reads: list[str], makes: str, kernel: Callable, rows: int = 256) -> DataFrame:
    """Keep columns kept of df as they are and add those of the schema makes, computed from columns reads.

    kernel takes a list of values for each column read, for at most rows rows, and returns the number of the row that
    each result belongs to (None: one result a row, in order) and a list for each column made. Kept columns stay in Arrow,
    so that nulls and large integers pass unchanged.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    made = df.sparkSession.createDataFrame([], makes).schema
    old_columns = df.select(*map(named, kept))
    schema = StructType([*old_columns.schema.fields, *made.fields])
    names = [f.name for f in schema]
    kinds = [to_arrow_type(f.dataType) for f in made]
    private = [named(c).alias(f"__kept{k}") for k, c in enumerate(kept)] + [named(c).alias(f"__read{k}") for k, c in enumerate(reads)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, rows):
                some = batch.slice(first, rows)
                index, *values = kernel(*(some.column(len(kept) + k).to_pylist() for k in range(len(reads))))
                old = [some.column(k) for k in range(len(kept))]
                if index is not None:
                    old = [c.take(pa.array(index, type=pa.int64())) for c in old]
                yield pa.RecordBatch.from_arrays([*old, *(pa.array(v, type=t) for v, t in zip(values, kinds, strict=True))], names=names)
        release_memory()

    return df.select(*private).mapInArrow(run, schema)


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], rows: str, total: int, by: list[str] | None = None) -> DataFrame:
    """Inner join of left with right (one row a key) in which rows of hot keys stay spread: columns of left, then right's others.

    Column rows of right says how many rows of left each key has, of total in all. Hot keys (see HOT_KEYS) are few, whatever
    the tables, and are broadcast; their rows of left are dealt by a hash of columns by (all of left by default), all others by
    the keys.
    """
    hot = F.col(rows) > max(HOT_ROWS, total / HOT_KEYS)
    others = [c for c in right.columns if c not in keys]
    few = right.where(hot).select(*keys, F.struct(*others).alias("__hot"))
    # 0 for all, but no literal: the optimiser would take that out of the join's keys
    zero = F.when(F.col(rows) < 0, F.col(rows)).otherwise(F.lit(0)).cast("long")
    rest = right.where(~hot).select(*keys, F.struct(*others).alias("__cold"), zero.alias("__spread"))
    spread = F.when(F.col("__hot").isNotNull(), F.xxhash64(*(by or left.columns))).otherwise(F.lit(0).cast("long"))
    marked = left.join(F.broadcast(few), keys, "left").withColumn("__spread", spread)
    joined = marked.join(rest, [*keys, "__spread"], "left").withColumn("__found", F.coalesce("__hot", "__cold")).where("__found is not null")
    return joined.select(*left.columns, *(F.col("__found")[c].alias(c) for c in others))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer, for arrays of uint64."""
    x = x + GOLDEN
    x = (x ^ (x >> U64(30))) * MIX_A
    x = (x ^ (x >> U64(27))) * MIX_B
    return x ^ (x >> U64(31))


class _Powers:
    """Powers of POLY and of its inverse modulo 2**64, grown on demand."""

    up = np.ones(1, dtype=U64)
    down = np.ones(1, dtype=U64)
    inverse = U64(pow(int(POLY), -1, 1 << 64))

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, CHUNK_BYTES + (1 << 16))
            for name, base in (("up", POLY), ("down", cls.inverse)):
                steps = np.full(size, base, dtype=U64)
                steps[0] = U64(1)
                setattr(cls, name, np.multiply.accumulate(steps))
        return cls.up, cls.down


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash each maximal run of non-space bytes of raw (uint8). Returns hashes, starts and ends of the words."""
    space = SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.empty(0, dtype=U64), starts, ends
    up, down = _Powers.get(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=U64)
    np.cumsum((raw.astype(U64) + U64(1)) * up[: len(raw)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts]), starts, ends


def chunks(texts: list[str | None], lower: bool = True, size_of: int = CHUNK_BYTES):
    """Yield (first, raw bytes as uint8, offsets) for runs of texts of about size_of bytes; a text is never cut.

    Null counts as empty. One line feed follows each text, so that words never span two texts.
    """
    parts: list[bytes] = []
    offsets, first, size = [0], 0, 0
    for k, text in enumerate(texts):
        text = text or ""
        part = (text.lower() if lower else text).encode("utf-8", "surrogatepass") + b"\n"
        parts.append(part)
        size += len(part)
        offsets.append(size)
        if size >= size_of:
            yield first, np.frombuffer(b"".join(parts), dtype=np.uint8), np.array(offsets)
            parts, offsets, first, size = [], [0], k + 1, 0
    if parts:
        yield first, np.frombuffer(b"".join(parts), dtype=np.uint8), np.array(offsets)
