"""Small helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker tokenises at once; bounds its memory for any batch size.
CHUNK_BYTES = 400_000
#: Bytes of a batch that goes to a Python worker, if it has more than one row.
BATCH_BYTES = 4 << 20

# Bytes that are not part of an alphanumeric word: all ASCII but digits and letters.
_ALNUM = bytes(
    b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(df: DataFrame) -> DataFrame:
    """`df`; its session from now on sends BATCH_BYTES at most at once to Python workers, or one row."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark = df.sparkSession
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    return df


def released() -> None:
    """Give what a Python worker has freed back to the system: workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def lean(run: Callable) -> Callable:
    """`run`, a function of an iterator of batches, with memory released now and then and at its end."""

    def fed(batches: Iterator) -> Iterator:
        for n, b in enumerate(batches):
            if n % 16 == 15:
                released()
            yield b

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(fed(batches))
        released()

    return wrapped


def collected(spark: SparkSession) -> None:
    """Have the executors' JVMs collect their garbage and give back what they don't need of their heaps, which
    otherwise stay as large as an earlier stage made them beside the Python workers of the next one."""
    n = spark.sparkContext.defaultParallelism  # a task for each core, so that all executors get some
    spark.range(0, n, 1, n).selectExpr("reflect('java.lang.System', 'gc') AS done").collect()


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Only a local session without that setting gets a temporary folder, once.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isEmpty():
        return sc._jsc.sc().getCheckpointDir().get()
    folder = sc.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def dealt(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """`df` with all rows of a key in one task, sorted by the keys and then by `order`, for Python functions.

    By a hash of the keys: Spark leaves a repartition by the keys themselves out if a join or count below
    deals rows out by them already, and may then turn that into a broadcast join, which doesn't.
    """
    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame, slim: bool = False) -> DataFrame:
    """`df`, written to the shared folder and cut from its lineage.

    slim: its rows are a few numbers each, so that a file for eight shuffle partitions, or two a core if
    these are more, are enough.
    """
    spark = df.sparkSession
    shared_folder(spark)
    if slim:
        df = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    return df.checkpoint(eager=True)


def space_words(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.lower().split()


def alnum_words(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and any non-ASCII characters, A-Z in lower case."""
    return text.lower().translate(_ALNUM).split()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, for arrays of hashes."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Words:
    """Hashes of the words of many texts, without an object for each word.

    A word's hash is a polynomial of its bytes, read off running sums over the whole buffer, so equal
    words have equal hashes wherever they stand.
    """

    def __init__(self, alnum: bool):
        self.alnum = alnum
        space = b" \t\n\r\x0b\x0c"
        self.inside = np.array([(_ALNUM[b] != 0x20) if alnum else b not in space for b in range(256)])
        self.values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
        self._grow(1 << 19)

    def _grow(self, n: int) -> None:
        powers = np.full(n, _BASE, np.uint64)
        inverse = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        powers[0] = inverse[0] = 1
        with np.errstate(over="ignore"):
            self.powers, self.inverse = np.cumprod(powers, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)

    def hashes(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in a row, and the number of words up to the end of each text."""
        raws = [t.lower() for t in texts]
        buffer = np.frombuffer(b" ".join([b"", *raws, b""]), np.uint8)
        if len(buffer) > len(self.powers):
            self._grow(2 * len(buffer))
        inside = self.inside[buffer]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        first, last = edges[::2], edges[1::2]
        with np.errstate(over="ignore"):
            sums = np.cumsum(self.values[buffer] * self.powers[: len(buffer)], dtype=np.uint64)
            h = mix((sums[last] - sums[first]) * self.inverse[first])
        ends = np.cumsum([len(r) + 1 for r in raws])
        return h, np.searchsorted(first, ends)


#: Odd multiplier of the polynomial that combines word hashes into shingle hashes.
_BASE = 0x9E3779B97F4A7C15


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive words, given the words' hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = h[:n].copy()
        for j in range(1, k):
            out = out * np.uint64(_BASE) + h[j : j + n]
    return mix(out)


def text_chunks(batch: pa.RecordBatch, size: int = CHUNK_BYTES) -> Iterator[list[list]]:
    """Lists of the columns' values, a few rows at a time; the last column, text, comes as bytes (none for
    null), about `size` of them at once."""
    *others, text = batch.columns
    text = pc.fill_null(text.cast(pa.large_binary()), b"")
    ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False))
    first = 0
    while first < batch.num_rows:
        held = int(ends[first - 1]) if first else 0
        after = max(first + 1, int(np.searchsorted(ends, held + size)))
        yield [c.slice(first, after - first).to_pylist() for c in (*others, text)]
        first = after
