"""Helpers shared by the training-data operators.

Every operator reads only the columns it needs, under names of its own, so
extra input columns never clash. Rows are identified by content
(``row_key``), so null or repeated document ids neither crash nor mix texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.session import ensure_checkpoint_dir

# Unit of text that one vectorised step works on, in bytes: bounds the memory of a Python worker.
SLICE_BYTES = 1 << 19
# The characters that separate words in the query contracts: [\x20\x09-\x0D].
WORD_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text), the columns nearly every operator starts from."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def row_key(docs: DataFrame, name: str = "_key") -> DataFrame:
    """Adds a never-null content key: rows that share it have the same id and the same text."""
    return docs.withColumn(name, F.xxhash64(F.lit(7), F.col("doc_id"), F.col("text")))


def carried(docs: DataFrame) -> DataFrame:
    """(_row, doc_id, text, _key): whole rows as one column, so that no name of theirs can clash; ``select("_row.*")`` unpacks them."""
    return row_key(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                               F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet to the shared folder and reads it again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Removes a table of ``materialise`` that no later plan reads."""
    path = getattr(df, "_scratch", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def bounded_sample(rows: DataFrame, most: int, name: str) -> DataFrame:
    """The rows of a training sample, written once; of more than ``most``, about ``most`` chosen by a hash of row and place.

    The bound holds however many rows one id has, and is applied before a row reaches the driver.
    """
    whole = materialise(rows, name)
    n = whole.count()
    if n <= most:
        return whole
    key = F.xxhash64(F.monotonically_increasing_id(), *whole.columns)
    part = materialise(whole.filter(F.pmod(key, F.lit(1 << 40)) < int((1 << 40) * most / n)), name)
    discard(whole)
    return part


def crc32_mod(col: Column, n: int = 5) -> Column:
    """crc32 of a column as text, modulo n (null: the crc of an empty text)."""
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it and wherever the optimizer moves it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_array(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, as an array, with plain splits (null: none)."""
    blank = F.regexp_replace(F.coalesce(text, F.lit("")), "[\t-\r]", " ")
    return F.array_remove(F.split(blank, " "), "")


def text_slices(batches: Iterator[pa.RecordBatch], max_bytes: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts Arrow batches with a ``text`` column into runs of rows of about max_bytes.

    Yields (rows, bytes, offsets): the UTF-8 bytes of the run's texts end to
    end and where each starts. Nulls are empty. A single longer text is a run
    of its own, so nothing is cut.
    """
    for batch in batches:
        text = batch.column(batch.schema.get_field_index("text")).cast(pa.large_string())
        if text.null_count:
            text = text.fill_null("")
        off = np.frombuffer(text.buffers()[1], np.int64)[text.offset: text.offset + len(text) + 1]
        raw = text.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(text):
            to = max(at + 1, int(np.searchsorted(off, off[at] + max_bytes, "right")) - 1)
            yield batch.slice(at, to - at), data[off[at]: off[to]], off[at: to + 1] - off[at]
            at = to


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers (two multiply-xorshift rounds)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_MULTIPLIERS = np.zeros(0, np.uint64)


def multipliers(n: int) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    global _MULTIPLIERS
    if len(_MULTIPLIERS) < n:
        _MULTIPLIERS = mix64(np.arange(1, max(n, 512) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return _MULTIPLIERS[:n]


def separators(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


SPACES = separators(WORD_SPACE)


def split_words(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts that lie end to end in ``data``: (hash, start, end, row of each word)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    solid = ~sep[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:n]
    end[:-1] &= ~solid[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    if not len(starts):
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    length = ends - starts
    table_ = multipliers(int(length.max()))
    lead = int(starts[0])
    place = np.arange(lead, n) - np.repeat(starts, np.diff(starts, append=n))
    np.minimum(place, len(table_) - 1, out=place)
    part = (data[lead:].astype(np.uint64) + np.uint64(1)) * table_[place]
    part *= solid[lead:]
    h = mix64(np.add.reduceat(part, starts - lead) + length.astype(np.uint64))
    row = np.searchsorted(offsets, starts, "right") - 1
    return h, starts, ends, row


def gram_hashes(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and whether they lie in one row (length n - k + 1)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    mult = multipliers(512)[100: 100 + k] if k <= 400 else multipliers(100 + k)[100: 100 + k]
    g = h[:n] * mult[0]
    for j in range(1, k):
        g += h[j: n + j] * mult[j]
    return mix64(g), row[:n] == row[k - 1:]


def ship_code(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once a session, as a cluster may not have it installed."""
    import os
    import tempfile
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_retentia_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    at = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="retentia-code-")), "retentia.zip")
    with zipfile.ZipFile(at, "w") as z:
        for folder, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.join("retentia", os.path.relpath(path, top)))
    sc.addPyFile(at)
    sc._retentia_shipped = True
