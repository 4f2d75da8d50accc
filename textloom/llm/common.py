"""What the operators of this subpackage share: tables, written intermediate tables, hashing and tokens."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="textloom-"))
    return sc.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textloom-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM has ended already: the folder is the cluster's to clean
        pass


def free_names(taken: list[str], *names: str) -> list[str]:
    """Names for columns of our own that no given column has, whatever its case."""
    lower = {t.lower() for t in taken}
    out = []
    for n in names:
        while n.lower() in lower:
            n += "_"
        out.append(n)
    return out


def remainder(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as remainder 1, so it is never held out of a fold by accident."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod, F.lit(1))


def total_bytes(df: DataFrame, text_col: str) -> tuple[int, int]:
    """Rows and UTF-8 bytes of a text column, for choosing numbers of chunks; one narrow scan."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("b")).first()
    return r["n"], r["b"]


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split on space, tab, LF, VT, FF and CR only: what bytes.lower and bytes.split do."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHash(dict):
    """word (bytes) -> 64-bit hash, remembered up to a size; forgetting only costs time."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _P2
    return h ^ (h >> np.uint64(29))


def ngram_hashes(w: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-grams of a sequence of word hashes, in order; a shorter sequence is one gram."""
    if not len(w):
        return w
    n = min(n, len(w))
    m = len(w) - n + 1
    h = np.full(m, n, np.uint64)
    for j in range(n):
        h = mix((h + w[j : m + j]) * _P1)
    return h


def word_array(words: list[bytes], hashes: WordHash) -> np.ndarray:
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
