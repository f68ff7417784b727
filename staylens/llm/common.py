"""Helpers shared by the text operators: scans, word hashing, window hashing.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D.  Those bytes
never occur inside a multi-byte UTF-8 character and are exactly what
``bytes.split()`` splits on, so the UTF-8 bytes are split without decoding.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MAX_BITS = 1 << 27  # a bit table has 16 MB at most, the bound of what is broadcast
_BLOCK = 1 << 16
BATCH_ROWS = 512
CACHE_WORDS = 1 << 16  # distinct words whose hash a Python worker remembers: 9 MB; rarer ones cost little more to hash again
_MASK = (1 << 64) - 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Texts are long: tasks get BATCH_ROWS rows at a time where the session has Spark's default of 10,000."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) >= 10_000:
        spark.conf.set(name, str(BATCH_ROWS))


def id_and_text(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns an operator works on; other columns, whatever their names, are left out."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text", *more)


def free_memory() -> None:
    """Memory that is no longer used goes back to the system: of Arrow's pool, and where the C library can, of its own."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def frees_memory(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task function whose Python worker, which Spark keeps for later tasks, does not hold on to what the task has freed."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        free_memory()

    return task


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def doc_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes], pa.RecordBatch]]:
    for batch in batches:
        if batch.num_rows:
            yield batch.column("doc_id"), text_bytes(batch.column("text")), batch


class WordHash(dict):
    """word -> 64-bit hash, remembered for the first CACHE_WORDS distinct words; the frequent ones are met early."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < CACHE_WORDS:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_CHUNKS = 8  # words of up to 64 bytes are hashed together
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # the first n bytes of a little-endian number


def word_hashes(words: bytes) -> np.ndarray:
    """64-bit hash of each word of a text whose only white space is 0x20, without a Python object a word.

    A word is read eight bytes at a time, all words at once: each step is a bijection of the bytes that
    it adds, so words of one length up to eight bytes never share a hash.  Longer than 64 bytes: XXH64.
    """
    padded = b" " + words + b" " * 8
    letters = np.frombuffer(padded, np.uint8)[: len(words) + 2] != 32
    edges = np.flatnonzero(letters[1:] != letters[:-1]) + 1
    start, length = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray(len(padded) - 7, np.dtype("<u8"), padded, strides=(1,))  # the eight bytes from each place on
    hashes = mix((eight[start] & _LOW[np.minimum(length, 8)]) + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    rows = np.flatnonzero(length > 8)
    for chunk in range(1, _CHUNKS):
        if not len(rows):
            return hashes
        at = 8 * chunk
        hashes[rows] = mix(hashes[rows] ^ (eight[start[rows] + at] & _LOW[np.minimum(length[rows] - at, 8)]))
        rows = rows[length[rows] > at + 8]
    for row in rows:
        hashes[row] = xxhash.xxh64_intdigest(padded[start[row] : start[row] + length[row]])
    return hashes


class Rolling:
    """Hashes of every window of k word hashes: sum of w[i+j] * r^j modulo 2^64, r odd."""

    def __init__(self, factor: int):
        self.factor, self.inverse = factor, pow(factor, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 4096)
            self.up, self.down = (np.cumprod(np.array([1] + [r] * (size - 1), np.uint64)) for r in (self.factor, self.inverse))

    def windows(self, words: np.ndarray, k: int) -> np.ndarray:
        n = len(words)
        if n < k:
            return np.empty(0, np.uint64)
        self._powers(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(words * self.up[:n], out=total[1:])
        return (total[k:] - total[:-k]) * self.down[: n - k + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    have = 1
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[width - have : width - have + n])


def _texts(bits: np.ndarray, mask: int):
    @frees_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = np.flatnonzero(in_table(batch.column("hash").to_numpy().view(np.uint64), bits, mask))
            yield batch.select(["doc_id", "hash", "text"]).take(pa.array(wanted))

    return run


def texts_of(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """doc_id, hash, text of the rows whose ``hash`` is in the one column of a written table, and of a few others."""
    table = docs.sparkSession.sparkContext.broadcast(bit_table(hashes))

    def run(batches):
        return _texts(*table.value)(batches)

    return docs.mapInArrow(run, "doc_id long, hash long, text string")


def sample(rows: DataFrame, label: str, per_class: int) -> DataFrame:
    """About ``per_class`` rows of each value of ``label``, chosen by a hash of ``doc_id``; all rows of smaller classes.

    Only for fitting models; the values of ``label`` are few.
    """
    counts = {r[label]: r["n"] for r in rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return rows.limit(0)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_class / n))])
    return rows.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < share[F.col(label)] * 1_000_000)


def crc_bucket(divisor: int):
    """crc32 of the id written as text, modulo ``divisor`` (null id: -1)."""
    return F.coalesce(F.expr(f"crc32(cast(cast(doc_id AS string) AS binary)) % {divisor}").cast("int"), F.lit(-1))


def _bit_block(frame: pd.DataFrame) -> pd.DataFrame:
    bits = np.zeros(_BLOCK, np.uint8)
    bits[frame["low"].to_numpy()] = 1
    return pd.DataFrame({"block": [frame["block"].iloc[0]], "bits": [np.packbits(bits, bitorder="little").tobytes()]})


def bit_table(hashes: DataFrame, max_bits: int = MAX_BITS, per_hash: int = 16) -> tuple[np.ndarray, int]:
    """Bit table (and its mask) of the 64-bit hashes in the one column of a written table.

    About ``per_hash`` bits a hash up to ``max_bits``; past that the table has more false
    positives, so it only ever serves to spare work before an exact join.
    """
    size, n, name = _BLOCK, hashes.count(), hashes.columns[0]
    while size < min(max_bits, per_hash * n):
        size *= 2
    slot = F.col(name).bitwiseAND(size - 1)
    blocks = hashes.select(F.shiftright(slot, 16).cast("int").alias("block"), slot.bitwiseAND(_BLOCK - 1).cast("int").alias("low")).distinct()
    bits = np.zeros(size // 8, np.uint8)
    for row in blocks.groupBy("block").applyInPandas(_bit_block, "block int, bits binary").toLocalIterator():
        bits[row.block * _BLOCK // 8 : (row.block + 1) * _BLOCK // 8] = np.frombuffer(row.bits, np.uint8)
    return bits, size - 1


def in_table(hashes: np.ndarray, bits: np.ndarray, mask: int) -> np.ndarray:
    slot = (hashes & np.uint64(mask)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0
