"""Packing token sequences into windows by non-negative least squares.

Each document is its token ids and an end id.  Full windows are cut off it
first; what is left has a length below the window.  Shallow combinations of
two, three or four lengths that fill a window exactly are the columns of a
non-negative least squares problem whose right-hand side is the histogram of
those lengths.  Rounded and clipped, the solution says how often each
combination is used; the remaining pieces are laid end to end in length order
and cut at every window, so only the last window is not full.  It is split
into sequences of lengths that are powers of two, which need no padding.

Documents of one length are numbered by (length, salt), so a length that
many copies share is spread over tasks; its offsets come from a table with a
row per (length, salt).  The histogram (below ``window`` rows) and the
combinations are all that reaches the driver.

Tokens are found word by word: the tokenizer drops white space and never
joins across it, so a task remembers the ids of frequent words.

Defined cases: null and empty texts are the end id alone; every row is packed,
repeated ones too, told apart by ``row_id``; an empty table gives no rows;
other columns are not looked at.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from staylens.llm.common import doc_batches, free_memory, frees_memory, id_and_text, texts_of
from staylens.session import cut_lineage

WINDOW = 4096
END = 2
SALTS = 64
FREQUENT = 96  # lengths that combinations of three and four are made of
CACHE_WORDS = 450_000
_STOP = re.compile(rb"([,.])(?=[ \n])(?<=[a-z][,.])")  # begins with the mark, so the scan skips from mark to mark


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The character that byte-level BPE writes for each byte: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Ids(dict):
    """word -> its token ids as little-endian unsigned 32-bit integers, for the words met first.

    Case doesn't matter to the tokenizer, and a comma or full stop after a
    letter is a token of its own, so neither makes another word to remember;
    texts with a marker of special tokens are left as they are.  A word of
    nothing but lower-case letters is one piece for the model, which takes it
    directly; other words go through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, byte_letters()

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if text.isalpha() and text.lower() == text and (text.isascii() or unicodedata.is_normalized("NFC", text)):
            ids = [t.id for t in self.model.tokenize(word.decode("latin-1").translate(self.letters))]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        data = array("I", ids).tobytes()
        if len(self) < CACHE_WORDS:
            self[word] = data
        return data

    def of(self, texts: list[bytes], end: bytes) -> list[bytes]:
        """Token ids of each text, and the end id."""
        docs = ((t if b"<|" in t else _STOP.sub(rb" \1", t.lower())).split() for t in texts)
        return [b"".join(map(self.__getitem__, d)) + end for d in docs]


@functools.lru_cache(1)
def loaded(path: str) -> Ids:
    """Once a Python worker: a tokenizer leaves some of its memory behind, several MB a task if each task loads its own."""
    ids_of = Ids(path)
    free_memory()
    return ids_of


def _with_ids(path: str, run: Callable[[Ids, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task function whose worker keeps the tokenizer but forgets the words of the task."""

    @frees_memory
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = loaded(path)
        try:
            yield from run(ids_of, batches)
        finally:
            ids_of.clear()

    return task


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    return (b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows))


def _pieces(path: str, window: int, end_id: int):
    """Full windows (start, length, crc) and the rest of each document."""

    def run(ids_of: Ids, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for ids, texts, batch in doc_batches(_slices(batches)):
            at, start, length, crc, total = [], [], [], [], []
            for row, data in enumerate(ids_of.of(texts, end)):
                n = len(data) // 4
                for s in range(0, n, window):
                    at.append(row)
                    start.append(s)
                    length.append(min(window, n - s))
                    crc.append(zlib.crc32(data[4 * s : 4 * (s + window)]))
                    total.append(n)
            take = pa.array(at, pa.int64())
            numbers = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
            yield pa.RecordBatch.from_arrays(
                [ids.take(take), batch.column("hash").take(take), *numbers], names=["doc_id", "hash", "start", "length", "ids_crc32", "doc_tokens"]
            )

    return _with_ids(path, run)


def _recut(path: str, end_id: int):
    """Checksums of the cut pieces of a document: cuts is a list of (piece_id, start, length)."""

    def run(ids_of: Ids, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for _, texts, batch in doc_batches(_slices(batches)):
            piece, start, crc = [], [], []
            for data, cuts in zip(ids_of.of(texts, end), batch.column("cuts").to_pylist(), strict=True):
                for c in cuts:
                    piece.append(c["piece_id"])
                    start.append(c["start"])
                    crc.append(zlib.crc32(data[4 * c["start"] : 4 * (c["start"] + c["length"])]))
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int64()), pa.array(start, pa.int64()), pa.array(crc, pa.int64())], names=["piece_id", "start", "crc"])

    return _with_ids(path, run)


def combinations(histogram: np.ndarray, window: int) -> np.ndarray:
    """Rows of four lengths (0 fills up) that sum to the window, from lengths that occur."""
    have = np.flatnonzero(histogram)
    have = have[have > 0]
    pairs = np.stack([have, window - have], 1)
    pairs = pairs[(pairs[:, 0] <= pairs[:, 1]) & (histogram[pairs[:, 1]] > 0)]
    often = have[np.argsort(-histogram[have], kind="stable")][:FREQUENT]
    a, b = (x.ravel() for x in np.meshgrid(often, often, indexing="ij"))
    keep = a <= b
    a, b = a[keep], b[keep]
    out = [np.pad(pairs, ((0, 0), (0, 2)))]
    c = window - a - b
    good = (c >= b) & (histogram[np.clip(c, 0, window)] > 0)
    out.append(np.stack([a[good], b[good], c[good], 0 * c[good]], 1))
    d = window - 2 * a - b  # twice one length
    good = (d > 0) & (histogram[np.clip(d, 0, window)] > 0)
    out.append(np.stack([a[good], a[good], b[good], d[good]], 1))
    return np.unique(np.sort(np.concatenate(out), axis=1)[:, ::-1], axis=0) if have.size else np.empty((0, 4), np.int64)


def nnls(columns: np.ndarray, histogram: np.ndarray, rounds: int = 300) -> np.ndarray:
    """x >= 0 that brings the lengths used by the combinations near the histogram, by accelerated projected gradient."""
    x = y = np.zeros(len(columns))
    used = columns > 0
    target = histogram.astype(float)
    rate = 1.0 / max(1.0, 16.0 * np.bincount(columns[used], minlength=len(target)).max()) if used.any() else 1.0
    rate *= 4
    momentum = 1.0
    for _ in range(rounds):
        fit = np.zeros(len(target))
        np.add.at(fit, columns.ravel(), np.repeat(y, 4) * used.ravel())
        gradient = ((fit - target)[columns] * used).sum(1)
        after = np.maximum(0, y - rate * gradient)
        nxt = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        x, y, momentum = after, after + (momentum - 1) / nxt * (after - x), nxt
        y = np.maximum(y, 0)
    return x


def repeats(histogram: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Combinations and how often each is used, never more than the histogram holds."""
    columns = combinations(histogram, window)
    if not len(columns):
        return columns, np.zeros(0, np.int64)
    x = nnls(columns, histogram)
    left = histogram.astype(np.int64).copy()
    times = np.zeros(len(columns), np.int64)
    for i in np.argsort(-x, kind="stable"):
        lengths, need = np.unique(columns[i][columns[i] > 0], return_counts=True)
        times[i] = min(int(round(x[i])), int((left[lengths] // need).min()))
        left[lengths] -= need * times[i]
    for i in np.argsort((columns > 0).sum(1), kind="stable"):  # what rounding left over
        lengths, need = np.unique(columns[i][columns[i] > 0], return_counts=True)
        more = int((left[lengths] // need).min())
        times[i] += more
        left[lengths] -= need * more
    return columns, times


def slots(histogram: np.ndarray, window: int) -> tuple[list[tuple], int]:
    """(length, first rank, end rank, first window, pieces a window, offset) of each place in the used combinations."""
    columns, times = repeats(histogram, window)
    rank = np.zeros(len(histogram), np.int64)
    rows, windows = [], 0
    for lengths, count in zip(columns.tolist(), times.tolist(), strict=True):
        offset = 0
        for length in (x for x in lengths if x and count):
            rows.append((length, int(rank[length]), int(rank[length]) + count, windows, offset))
            rank[length] += count
            offset += length
        windows += count
    return rows, windows


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = END, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, row_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = path or tokenizer_path()
    docs = id_and_text(docs).withColumn("hash", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    kinds = "doc_id long, hash long, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = cut_lineage(docs.mapInArrow(_pieces(path, window, end_id), kinds).withColumn("piece_id", F.monotonically_increasing_id()), "op5-pieces")
    spark = docs.sparkSession

    rest = pieces.where(F.col("length") < window).withColumn("salt", F.pmod(F.xxhash64("piece_id"), F.lit(SALTS)).cast("int"))
    counts = rest.groupBy("length", "salt").agg(F.count("*").alias("n"))  # below window * SALTS rows
    counts = cut_lineage(counts, "op5-counts")
    histogram = np.zeros(window + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).toLocalIterator():
        histogram[row.length] = row.n
    rows, windows = slots(histogram, window)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("length", "salt", before.alias("base"))
    ranked = rest.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("piece_id")) - 1)
    ranked = ranked.join(F.broadcast(offsets), ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base")

    used = np.zeros(window + 1, np.int64)
    for length, _, stop, _, _ in rows:
        used[length] = max(used[length], stop)
    spare = [(int(i), int(used[i])) for i in np.flatnonzero(histogram)]  # below window rows
    left = np.array([histogram[i] - u for i, u in spare], np.int64)
    lengths = np.array([i for i, _ in spare], np.int64)
    begin = np.concatenate(([0], np.cumsum(left * lengths)))[:-1].tolist() if spare else []
    total = int((left * lengths).sum())
    spare_table = spark.createDataFrame([(i, u, b) for (i, u), b in zip(spare, begin, strict=True)], "length long, used long, begin long")
    ranked = cut_lineage(ranked.join(F.broadcast(spare_table), "length"), "op5-ranked")

    full = pieces.where(F.col("length") == window)
    n_full = full.count()
    # whole windows: one sequence each, numbered through counts by partition of their numbers
    full = full.withColumn("part", F.shiftright("piece_id", 33))
    parts = cut_lineage(full.groupBy("part").agg(F.count("*").alias("n")), "op5-parts")  # a row per task of the first pass
    base = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = full.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("piece_id")) - 1).join(
        F.broadcast(parts.select("part", base.alias("base"))), "part"
    )
    out = ["doc_id", "piece_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole = numbered.withColumn("sequence_id", F.col("base") + F.col("k")).withColumn("offset", F.lit(0).cast("long")).select(*out)

    # places in combinations; a length has as many ranges as combinations use it, looked up in a sorted array
    by_length: dict[int, list] = {}
    for length, first, stop, window_no, offset in rows:
        by_length.setdefault(length, []).append((first, stop, window_no, offset))
    kinds = "length long, places array<struct<first:long,stop:long,window_no:long,offset:long>>"
    places = spark.createDataFrame([(k, v) for k, v in by_length.items()], kinds)
    hit = ranked.where("rank < used").join(F.broadcast(places), "length")  # at most window rows
    hit = hit.withColumn("p", F.expr("filter(places, p -> p.first <= rank AND rank < p.stop)[0]"))
    combined = hit.withColumn("sequence_id", F.lit(n_full) + F.col("p.window_no") + F.col("rank") - F.col("p.first")).withColumn("offset", F.col("p.offset"))
    combined = combined.select(*out)

    # the rest, end to end; pieces that cross a window's end are cut there
    ends = last_sequences(total, window)
    at = F.col("begin") + (F.col("rank") - F.col("used")) * F.col("length")
    line = ranked.where("rank >= used").withColumn("at", at)
    edges = F.array(*[F.lit(e) for e in ends[:-1]]).cast("array<long>") if len(ends) > 1 else F.array().cast("array<long>")
    stop = F.col("at") + F.col("length")
    full_windows = total // window
    first_cut, last_cut = F.floor(F.col("at") / window) + 1, F.floor((stop - 1) / window)
    window_cuts = F.when(first_cut <= last_cut, F.transform(F.sequence(first_cut, last_cut), lambda w: w * window)).otherwise(F.array().cast("array<long>"))
    tail_cuts = F.filter(edges, lambda e: (e > F.col("at")) & (e < stop))
    cuts = F.array_distinct(F.concat(F.array("at"), F.filter(window_cuts, lambda c: c <= full_windows * window), tail_cuts))
    line = line.withColumn("cuts", F.concat(F.array_sort(cuts), F.array(stop)))
    line = line.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("cuts") - 2)))
    low, high = F.expr("cuts[i]"), F.expr("cuts[i + 1]")
    tail_no = F.size(F.filter(edges, lambda e: e <= low)).cast("long")
    first_edge = F.lit(full_windows * window)
    tail_start = F.coalesce(F.array_max(F.filter(F.concat(F.array(first_edge), edges), lambda e: e <= low)), first_edge)
    inside = low < first_edge
    line = line.select(
        "doc_id", "piece_id", "hash", (F.col("start") + low - F.col("at")).alias("start"), (high - low).alias("length"), "ids_crc32", "doc_tokens",
        (F.lit(n_full + windows) + F.when(inside, F.floor(low / window)).otherwise(F.lit(full_windows) + tail_no)).cast("long").alias("sequence_id"),
        F.when(inside, F.pmod(low, F.lit(window))).otherwise(low - tail_start).alias("offset"), (F.size("cuts") > 2).alias("cut"),
    )
    line = cut_lineage(line, "op5-line")
    # checksums of cut pieces only: at most two documents for every window of the rest
    again = line.where("cut").groupBy("doc_id", "hash").agg(F.collect_set(F.struct("piece_id", "start", "length")).alias("cuts"))
    again = cut_lineage(again, "op5-cuts")
    texts = texts_of(docs, again.select("hash"))
    texts = texts.alias("d").join(again.alias("a"), F.expr("d.hash = a.hash AND d.doc_id <=> a.doc_id")).select("d.doc_id", "text", "cuts")
    crcs = texts.mapInArrow(_recut(path, end_id), "piece_id long, start long, crc long").dropDuplicates(["piece_id", "start"])
    line = line.join(crcs, ["piece_id", "start"], "left").withColumn("ids_crc32", F.when(F.col("cut"), F.col("crc")).otherwise(F.col("ids_crc32")))
    return whole.unionByName(combined).unionByName(line.select(*out))


def last_sequences(total: int, window: int) -> list[int]:
    """Ends of the sequences after the last full window: its length as a sum of powers of two, largest first."""
    at, out = total // window * window, []
    for power in reversed(range(window.bit_length())):
        if (total % window) >> power & 1:
            at += 1 << power
            out.append(at)
    return out
