"""Helpers that the operators of this folder share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the word separator of every contract here (Java and RE2 syntax alike).
SPACE = r"[\x20\x09-\x0D]+"


#: Unsigned CRC-32 of an ASCII column `s` in DuckDB's SQL.
CRC32_SQL = """xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(1, length(s) + 1), lambda i: ascii(s[i])::BIGINT),
  lambda c, b: list_reduce([xor(c, b)] || [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[], lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local session (a test) gets a
    folder of its own; on a cluster that is an error, as executors would write where nobody else can read."""
    jsc = spark.sparkContext._jsc.sc()
    given = spark.conf.get("spark.checkpoint.dir", None)
    if jsc.getCheckpointDir().isEmpty():
        if not given and not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(given or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return given or jsc.getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a narrow table with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes an intermediate table as Parquet in the shared folder and reads it back (columns are then pruned). The
    folder goes when the application ends, or before that with release()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes what staged() wrote for these tables; nothing that is still to run may read them."""
    for df in tables:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def sealed(df: DataFrame, *wanted: str) -> tuple[DataFrame, list[str]]:
    """df with numbered column names, which none of an operator's own names can clash with, and the numbers of the wanted
    columns. `toDF(*names)` gives the columns their names back."""
    return df.toDF(*[f"in{i}" for i in range(len(df.columns))]), [f"in{df.columns.index(c)}" for c in wanted]


def words_of(text: Column) -> Column:
    """Words of a text in order; null gives an empty array."""
    return F.coalesce(F.array_remove(F.split(text, SPACE), ""), F.array().cast("array<string>"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tidy(run):
    """run(batches) for mapInArrow, after which the worker gives back the memory that it holds and no longer uses: workers
    wait for their next task with it, while the stages between need it for the JVM."""

    def tidied(batches):
        import ctypes

        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return tidied


def bit_table(hashes: DataFrame, bits: int):
    """A table of 2 ** bits bits, set where the column h (64-bit hashes) points by its high bits; its size is fixed, and a
    bit set by chance only lets something through. Returns it as 64-bit words."""
    import numpy as np

    word = F.shiftrightunsigned("h", 64 - (bits - 6))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("h", 64 - bits).bitwiseAND(F.lit(63)).cast("int"))
    rows = hashes.select(word.alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[rows.column("w").to_numpy()] = rows.column("b").to_numpy().view(np.uint64)
    return table


def has_bit(table, h):
    """Which of the unsigned hashes h have their bit set."""
    import numpy as np

    bits = np.uint64(len(table).bit_length() - 1 + 6)
    at = h >> (np.uint64(64) - bits)
    return (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def whole_groups(batches, keys: list[str]):
    """Tables of whole groups from batches that are sorted by integer keys; only the last group waits for its next rows."""
    import numpy as np
    import pyarrow as pa

    carry = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if carry is not None:
            table = pa.concat_tables([carry, table]).combine_chunks()
        same = np.ones(table.num_rows, bool)
        for k in keys:
            v = table.column(k).to_numpy()
            same &= v == v[-1]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield table.slice(0, cut).combine_chunks()
        carry = table.slice(cut)
    if carry is not None:
        yield carry.combine_chunks()


def local_roots(n, left, right):
    """Component label (smallest member) of each of n nodes that the pairs left-right link."""
    import numpy as np

    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label
