"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import hashlib
import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.folders import remove, shared_root

#: Rows that a Python task handles at a time; a slice also ends at this many bytes of text.
SLICE_BYTES = 1 << 20

#: Tables of bits have so many places, in powers of two, and are made in blocks.
LEAST_BITS, MOST_BITS = 16, 27
BLOCK_BITS = 1 << 13

#: A column name that no input column is likely to have.
TEXT = "__text"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables, read by Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the one the cluster names in ``spark.checkpoint.dir``, which all executors share;
    where that is unset, one of this machine, if Spark runs on it alone."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(spark))
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """``df`` cut off from its lineage by a reliable checkpoint; for narrow rows, as these aren't compressed."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: The tables that this driver has written, in order.
_tables: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """``df`` cut off from its lineage by a compressed table in the same shared folder."""
    path = f"{_shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _tables.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_alone(make: Callable[[], DataFrame], spark: SparkSession) -> DataFrame:
    """What ``make`` gives, written; the tables that were written on the way to it are removed, as nothing needs them."""
    before = len(_tables)
    found = written(make())
    for path in _tables[before:-1]:
        remove(spark, path)
    del _tables[before:-1]
    return found


def byte_list(column: pa.Array) -> list[bytes | None]:
    """A string column's values as UTF-8 bytes, without a detour over str."""
    return column.cast(pa.binary()).to_pylist()


def slices(batches: Iterable[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each has at most SLICE_BYTES of text (or one row)."""
    for batch in batches:
        n = batch.num_rows
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i in range(n):
            if i > start and total + sizes[i] > SLICE_BYTES:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += sizes[i]
        if start < n:
            yield batch.slice(start, n - start)


#: What a worker keeps from one task to the next, by the module that made it. Functions below see to it, as only they
#: are the same in all tasks of a worker.
_kept: dict[str, dict[str, Any]] = {}


def kept(owner: str, mark: str, make: Callable[[], Any]) -> Any:
    """What ``make`` gave for this mark, kept for the worker's next tasks until its owner asks for another one."""
    own = _kept.setdefault(owner, {})
    if mark not in own:
        own.clear()
        own[mark] = make()
    return own[mark]


def release(owner: str) -> None:
    """Lets go of what other modules keep: idle workers stay, and would hold the tables of every operator they have run."""
    for other in [k for k in _kept if k != owner]:
        del _kept[other]
    trim()


def trim() -> None:
    """Gives freed memory back to the system. The C library keeps it otherwise, and idle workers would hold on to the
    largest amount that they ever had."""
    pa.default_memory_pool().release_unused()
    if give_back := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give_back(0)


def map_slices(df: DataFrame, text: str, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` over slices bounded by bytes of the text column."""
    owner = fn.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(owner)
        try:
            yield from fn(slices(batches, text))
        finally:
            trim()

    return df.mapInArrow(run, schema)


def running_totals(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all earlier rows of the same keys, as column before.

    Rows are dealt in ranges, so the rows of a key may be many tasks' work. A task sums up its own rows; what came before
    them is added for keys that began in an earlier range, of which a range has one at most.
    """
    places = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField("__part", T.IntegerType()), T.StructField("before", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, 0
        for batch in batches:
            before = []
            own = zip(*(batch.column(names.index(k)).to_pylist() for k in keys), strict=True)
            for key, n in zip(own, batch.column(names.index(value)).to_pylist(), strict=True):
                if key != last:
                    last, total = key, 0
                before.append(total)
                total += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.int64())], [*names, "__part", "before"])

    ranged = df.repartitionByRange(*places).sortWithinPartitions(*places)
    fixed = written(ranged.withColumn("__part", F.spark_partition_id()).mapInArrow(run, schema))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = fixed.groupBy(*keys, "__part").agg(F.sum(value).alias("__sum")).withColumn("__offset", F.sum("__sum").over(earlier)).where("__offset IS NOT NULL")
    parts = parts.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__part").alias("__of"), "__offset")
    same = [fixed[k].eqNullSafe(parts[f"__{k}"]) for k in keys]
    found = fixed.join(F.broadcast(parts), [fixed["__part"] == parts["__of"], *same], "left")  # a row for each range at most
    return found.select(*names, (F.col("before") + F.coalesce("__offset", F.lit(0))).alias("before"))


def bit_blocks(hashes: DataFrame, n: int, each: int = 8, probes: int = 1) -> tuple[DataFrame, int]:
    """A bit for each hash's place (or two places: its lower and its upper half), about ``each`` * n in all but at most
    2 ** MOST_BITS: (block, bits) of the blocks that have any, and how many bits there are (column hash)."""
    size = 1 << min(MOST_BITS, max(LEAST_BITS, (each * n).bit_length()))
    halves = [F.pmod(F.shiftrightunsigned("hash", 32 * k), F.lit(size)) for k in range(probes)]
    place = F.explode(F.array(*halves)).alias("place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            places = batch.column(1).to_numpy()
            order = np.argsort(places)
            places = places[order]
            cuts = np.flatnonzero(np.append(True, places[1:] // BLOCK_BITS != places[:-1] // BLOCK_BITS)) if len(places) else []
            for part in np.split(places, cuts[1:]) if len(places) else []:
                own = blocks.setdefault(int(part[0]) // BLOCK_BITS, np.zeros(BLOCK_BITS, bool))
                own[part % BLOCK_BITS] = True
        if blocks:
            yield pa.RecordBatch.from_pydict({"block": pa.array([*blocks], pa.int64()), "bits": [np.packbits(b).tobytes() for b in blocks.values()]})

    dealt = hashes.select(place).select(block_number(F.col("place")).alias("block"), "place").repartition("block")
    return dealt.mapInArrow(run, "block long, bits binary"), size


def block_number(place):
    return F.shiftright(place, BLOCK_BITS.bit_length() - 1)


def bits_of(hashes: DataFrame, n: int, each: int = 8, probes: int = 1) -> np.ndarray:
    """All bits of ``bit_blocks`` as one array."""
    blocks, size = bit_blocks(hashes, n, each, probes)
    bits = np.zeros((size // BLOCK_BITS, BLOCK_BITS // 8), np.uint8)
    for row in blocks.collect():  # 2 ** MOST_BITS bits in all
        bits[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return bits.ravel()


def with_maybe(df: DataFrame, key: str, hashes: DataFrame, n: int, name: str) -> DataFrame:
    """``df`` with whether a row's key may be among n hashes (column hash): a join with blocks of bits, of which all
    together have 2 ** MOST_BITS at most, so that they can be broadcast."""
    blocks, size = bit_blocks(hashes, n, 16)
    place = F.pmod(F.col(key), F.lit(size))
    inner = F.pmod(place, F.lit(BLOCK_BITS)).cast("int")
    byte = F.conv(F.hex(F.substring("__bits", F.shiftright(inner, 3) + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, 7 - inner.bitwiseAND(7)).bitwiseAND(1) == 1
    found = df.join(F.broadcast(blocks.toDF("__block", "__bits")), block_number(place) == F.col("__block"), "left")
    return found.select(*df.columns, F.coalesce(bit, F.lit(False)).alias(name))


def maybe(bits: np.ndarray, hashes: np.ndarray, probes: int = 1) -> np.ndarray:
    """Whether each hash may be among those that the table was made of; if not, it isn't."""
    found = np.ones(len(hashes), bool)
    for k in range(probes):
        place = ((hashes >> np.uint64(32 * k)) % np.uint64(8 * len(bits))).astype(np.int64)
        found &= (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1
    return found


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def crc_mod(column, divisor: int):
    """crc32 of the id as text, modulo ``divisor`` (null for a null id)."""
    return F.crc32(column.cast("string")) % F.lit(divisor)


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is on this machine; executors resolve it on theirs."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
