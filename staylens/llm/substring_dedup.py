"""Substring dedup: a word that lies in a 50-word passage of an earlier document is removed.

In place of a prefix-partitioned suffix tree, of which only the depth of
``window`` words would matter; no tree and no suffix order is built:

1. The anchor of a window is its smallest 8-word hash.  Equal windows have
   equal anchors, and neighbouring windows share theirs, so a document has
   about 2/43 anchors per word.  Anchors that occur in only one text lead to no
   repeat: their windows are dropped.
2. Windows with an anchor of two or more texts are grouped by the hash of all
   their words.  Of a group only the smallest document matters, so a group of
   any size is reduced before the shuffle and none is gathered in one task.
3. Whole texts that are equal word for word share every window; they are
   reduced to the smallest document first.

Windows are compared by rolling hashes, 96 bits of them.

The set of shared anchors reaches the second pass as a bit table of bounded
size; a false positive there costs work and changes no result.

Defined cases: null text has no words; texts under ``window`` words stay
whole; rows with a null ``doc_id`` count as larger than all others and stay
whole unless they repeat an earlier row; rows with one id, also of
different texts, have nothing removed on each other's account; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from staylens.llm.common import Rolling, WordHash, bit_table, doc_batches, id_and_text, in_table, mix, sliding_min
from staylens.session import cut_lineage

WINDOW = 50
ANCHOR = 8
_R1, _R2 = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def _sequence_hash(words: list[bytes]) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(b" ".join(words))
    return tuple(np.frombuffer(digest, np.int64).tolist())


def _anchors(hashes: np.ndarray, rolling: Rolling, window: int) -> np.ndarray:
    k = min(ANCHOR, window)
    return sliding_min(mix(rolling.windows(hashes, k)), window - k + 1)


def _survey(window: int):
    """One row per document: words, sequence hash, distinct anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, rolling = WordHash(), Rolling(_R1)
        for ids, texts, _ in doc_batches(batches):
            counts, seq, shas, anchors = [], [], [], []
            for text in texts:
                words = text.split()
                counts.append(len(words))
                seq.append(_sequence_hash(words))
                shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
                anchors.append(np.unique(_anchors(word.of(words), rolling, window)).view(np.int64) if len(words) >= window else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(counts, pa.int64()), pa.array([s[0] for s in seq], pa.int64()), pa.array([s[1] for s in seq], pa.int64()),
                 pa.array(shas), pa.array(anchors, pa.list_(pa.int64()))],
                names=["doc_id", "n_words", "s1", "s2", "all_sha256", "anchors"],
            )

    return run


def _suffixes(window: int, bits: np.ndarray, mask: int):
    """The full-depth prefixes of the suffixes under shared anchors, a row of arrays per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, first, second = WordHash(), Rolling(_R1), Rolling(_R2)
        for ids, texts, _ in doc_batches(batches):
            rows, seq, h1, h2, at = [], [], [], [], []
            for row, text in enumerate(texts):
                words = text.split()
                if len(words) < window:
                    continue
                hashes = word.of(words)
                where = np.flatnonzero(in_table(_anchors(hashes, first, window), bits, mask))
                if len(where):
                    rows.append(row)
                    seq.append(_sequence_hash(words))
                    h1.append(first.windows(hashes, window)[where].view(np.int64))
                    h2.append((second.windows(mix(hashes), window)[where] >> np.uint64(32)).astype(np.uint32).view(np.int32))
                    at.append(where.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows, pa.int64())), *(pa.array([s[k] for s in seq], pa.int64()) for k in (0, 1)), pa.array(h1, pa.list_(pa.int64())), pa.array(h2, pa.list_(pa.int32())), pa.array(at, pa.list_(pa.int32()))],
                names=["doc_id", "s1", "s2", "h1", "h2", "at"],
            )

    return run


def _removal(window: int):
    """Words left after the windows that start at ``starts`` are taken out; rows whose text is not that of the starts go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts, batch in doc_batches(batches):
            rows, removed, shas, kept_text = [], [], [], []
            own = zip(batch.column("s1").to_pylist(), batch.column("s2").to_pylist(), strict=True)
            for row, (text, starts, seq) in enumerate(zip(texts, batch.column("starts"), own, strict=True)):
                words = text.split()
                if _sequence_hash(words) != seq:
                    continue
                rows.append(row)
                edge = np.zeros(len(words) + 1, np.int32)
                starts = np.unique(starts.values.to_numpy())
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + window, -1)
                out = np.cumsum(edge[:-1]) > 0
                kept = b" ".join([words[i] for i in np.flatnonzero(~out)])
                removed.append(int(out.sum()))
                shas.append(hashlib.sha256(kept).hexdigest())
                kept_text.append(kept)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(rows, pa.int64())) for c in ("doc_id", "s1", "s2")), pa.array(removed, pa.int64()),
                 pa.array(shas, pa.string()), pa.array(kept_text, pa.binary()).cast(pa.string())],
                names=["doc_id", "s1", "s2", "n_removed", "kept_sha256", "kept_text"],
            )

    return run


def shared_anchors(survey: DataFrame) -> DataFrame:
    """The anchors that occur in two different texts."""
    rows = survey.select("s1", F.explode("anchors").alias("anchor"))
    return rows.groupBy("anchor").agg(F.min("s1").alias("a"), F.max("s1").alias("z")).where("a != z").select("anchor")


def repeated_passages(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(survey, starts): per document its word count and sequence class; per representative (id and class) the starts of removed windows."""
    docs = id_and_text(docs)
    survey = cut_lineage(
        docs.mapInArrow(_survey(window), "doc_id long, n_words long, s1 long, s2 long, all_sha256 string, anchors array<long>"), "op2-survey"
    )
    table = docs.sparkSession.sparkContext.broadcast(bit_table(cut_lineage(shared_anchors(survey), "op2-anchors")))

    def suffixes(batches):
        return _suffixes(window, *table.value)(batches)

    first = cut_lineage(survey.groupBy("s1", "s2", "n_words").agg(F.min("doc_id").alias("first_id")), "op2-first")
    paths = docs.where("doc_id IS NOT NULL").mapInArrow(suffixes, "doc_id long, s1 long, s2 long, h1 array<long>, h2 array<int>, at array<int>")
    paths = cut_lineage(paths.join(first.select("s1", "s2", F.col("first_id").alias("doc_id")), ["doc_id", "s1", "s2"]), "op2-paths")
    leaves = paths.select("doc_id", "s1", "s2", F.inline(F.arrays_zip("h1", "h2", "at")))
    nodes = leaves.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last")
    nodes = cut_lineage(nodes.select("h1", "h2", "owner"), "op2-nodes")
    starts = leaves.join(nodes, ["h1", "h2"]).where("doc_id > owner").groupBy("doc_id", "s1", "s2").agg(F.collect_set("at").alias("starts"))
    return survey.join(first, ["s1", "s2", "n_words"]), cut_lineage(starts, "op2-starts")


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    survey, starts = repeated_passages(docs, window)
    cut = id_and_text(docs).join(starts, "doc_id").mapInArrow(
        _removal(window), "doc_id long, s1 long, s2 long, n_removed long, kept_sha256 string, kept_text string"
    ).select("doc_id", "s1", "s2", "n_removed", "kept_sha256")
    whole = (F.col("doc_id").isNull() & F.col("first_id").isNotNull() | (F.col("doc_id") > F.col("first_id"))) & (F.col("n_words") >= window)
    copies = F.coalesce(whole, F.lit(False))
    nothing = hashlib.sha256(b"").hexdigest()
    rows = survey.join(cut.dropDuplicates(["doc_id", "s1", "s2"]), ["doc_id", "s1", "s2"], "left")
    return rows.select(
        "doc_id", "n_words",
        F.when(copies, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copies, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "all_sha256")).alias("kept_sha256"),
    )


def removed_text(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The words left of each document that loses a passage to an earlier one: doc_id, kept_text."""
    _, starts = repeated_passages(docs, window)
    cut = id_and_text(docs).join(starts, "doc_id").mapInArrow(
        _removal(window), "doc_id long, s1 long, s2 long, n_removed long, kept_sha256 string, kept_text string"
    )
    return cut.select("doc_id", "kept_text")
