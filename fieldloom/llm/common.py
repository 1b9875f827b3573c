"""Helpers shared by the text operators: checkpoints, word rules and vectorised word hashing over Arrow text."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Runs of space, tab, line feed, vertical tab, form feed and carriage return separate words. They are listed one by
#: one, as the regular expression engine looks single characters up in a table.
WORD = r"[^\x20\x09\x0A\x0B\x0C\x0D]+"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def shared_folder(spark) -> str:
    """The session's checkpoint folder: the one that spark.checkpoint.dir names. Only a local session without one gets a
    temporary folder; on a cluster its absence is an error, as executors don't share a machine's folders."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the session's shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> tuple[DataFrame, str]:
    """Cut the lineage with a written table in the session's shared folder; and its path."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark, path: str) -> None:
    """Remove a table that store() wrote."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def free_shuffles(spark) -> None:
    """Let Spark's cleaner remove the shuffle files that no live DataFrame refers to, between the rounds of an iteration."""
    gc.collect()
    spark._jvm.System.gc()


def squeeze_spaces(text: Column) -> Column:
    """Every run of ASCII white space becomes one space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(c), F.lit(" "))
    return F.when(F.contains(out, F.lit("  ")), F.regexp_replace(out, " {2,}", " ")).otherwise(out)


def word_count(text: Column) -> Column:
    """Number of maximal runs of other than ASCII white space; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------------------------------------------------------------
# Arrow text as one byte buffer

_RNG = np.random.default_rng(20240229)
#: A random odd-spread 64-bit value for each byte.
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POWERS = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x = x * _M2
    x ^= x >> np.uint64(31)
    return x


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (n + 1) of an Arrow string or binary array; null rows are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POWERS[int(base)] = have
    return have[:n]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and each row's number of words."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    fresh = np.zeros(n + 1, bool)  # a row starts here
    fresh[offsets[:-1]] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    first = inside & (~before | fresh[:n])
    fresh[offsets[-1]] = True
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    last = inside & (~after | fresh[1:])
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold_case: bool) -> np.ndarray:
    """A 64-bit hash of each word: a random-coded polynomial of its bytes and its length, finalised."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    if fold_case:
        data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    run = np.zeros(len(data) + 1, np.uint64)
    step = 1 << 20
    out = np.empty(len(starts), np.uint64)
    # The powers restart with each block of words, so that they stay short.
    block = powers(step)
    inverse = powers(step, np.uint64(pow(int(BASE), -1, 2**64)))
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + step, "right")))
        span = int(ends[to - 1] - base)
        p, q = (block, inverse) if span <= step else (powers(span), powers(span, np.uint64(pow(int(BASE), -1, 2**64))))
        run[1 : span + 1] = np.cumsum(BYTE_CODE[data[base : base + span]] * p[:span])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = (run[e] - run[s]) * q[s]
        at = to
    return mix(out + (ends - starts).astype(np.uint64) * _M2)


def shingle_hashes(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each row, and each row's number of them; a shorter row is one whole shingle."""
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(len(counts), np.int64)
    ends = np.cumsum(counts)
    number = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    width = np.minimum(counts, k)
    first = np.repeat(ends - counts - np.r_[0, np.cumsum(number)[:-1]], number) + np.arange(number.sum())
    width = np.repeat(width, number)
    out = np.full(len(first), np.uint64(k), np.uint64)
    for j in range(k):
        live = width > j
        value = words[np.where(live, first + j, first)]
        out = np.where(live, (out ^ value) * BASE + (value >> np.uint64(17)), out)
    return mix(out ^ width.astype(np.uint64)), number


def slices(column, most: int):
    """(first, last) row ranges of an Arrow string column, of at most `most` bytes or one row."""
    _, offsets = text_buffer(column)
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to
        at = to
