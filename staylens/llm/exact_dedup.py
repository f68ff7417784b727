"""Exact dedup by composable polynomial fingerprints and a chunkwise comparison.

A text is normalised (each run of 0x20 / 0x09-0x0D becomes one space) and its
UTF-8 bytes are cut into chunks.  Each chunk has a polynomial hash under two
moduli; ``combine`` joins neighbours by shifting the left hash by the length
of the right one, so chunks of a huge text can be hashed in any grouping.

Rows with equal (length, hashes) form a candidate group.  The smallest row of
the group is its reference; each member is compared with it chunk by chunk in
a join on (reference, salt, chunk number).  The salt spreads a large group
over many tasks: the reference's chunks are repeated once per SALT_ROWS
members, so no task meets more than that many members of one chunk.  Members
that differ (a hash collision) are grouped by their whole text instead.

Defined cases: null text counts as empty, and empty texts are equal to each
other; a null ``doc_id`` sorts last; rows repeated with the same id form one
group, of which one row is kept; an empty table gives no rows; other columns
of the input are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from staylens.llm.common import bit_table, doc_batches, frees_memory, id_and_text, in_table
from staylens.session import cut_lineage

CHUNK_BYTES = 1 << 16
SALT_ROWS = 256
BASE = 1_000_003
MODULI = (2_147_483_629, 2_147_483_587)  # primes below 2^31

_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_RUN = re.compile(b"  +")

_FP = "doc_id long, xx long, n_bytes long, h1 long, h2 long, text_sha256 string"


def normalise(data: bytes) -> bytes:
    data = data.translate(_SPACES)
    return _RUN.sub(b" ", data) if b"  " in data else data


def _powers(modulus: int, n: int = CHUNK_BYTES) -> np.ndarray:
    """BASE^(n-1) ... BASE^0 modulo ``modulus``."""
    out = np.ones(n, np.uint64)
    have, step = 1, BASE % modulus
    while have < n:  # out[have + i] = out[i] * BASE^have
        take = min(have, n - have)
        out[have : have + take] = out[:take] * np.uint64(step) % np.uint64(modulus)
        step = step * step % modulus
        have += take
    return out[::-1].copy()


def chunk_hashes(data: bytes, modulus: int, powers: np.ndarray) -> list[tuple[int, int]]:
    """(hash, length) of each chunk; the chunks are independent of each other."""
    values = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    out = []
    for i in range(0, len(values), len(powers)):
        part = values[i : i + len(powers)]
        out.append((int((part * powers[-len(part) :]).sum() % np.uint64(modulus)), len(part)))
    return out


def combine(left: tuple[int, int], right: tuple[int, int], modulus: int) -> tuple[int, int]:
    """Hash and length of two neighbouring pieces joined."""
    return (left[0] * pow(BASE, right[1], modulus) + right[0]) % modulus, left[1] + right[1]


def fingerprint(data: bytes, modulus: int, powers: np.ndarray) -> int:
    total = (0, 0)
    for piece in chunk_hashes(data, modulus, powers):
        total = combine(total, piece, modulus)
    return total[0]


def _fingerprints(moduli: tuple[int, int]):
    @frees_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = [_powers(m) for m in moduli]
        for ids, texts, batch in doc_batches(batches):
            texts = [normalise(t) for t in texts]
            h1, h2 = ([fingerprint(t, m, p) for t in texts] for m, p in zip(moduli, powers, strict=True))
            yield pa.RecordBatch.from_arrays(
                [ids, batch.column("xx"), pa.array(map(len, texts), pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()),
                 pa.array([hashlib.sha256(t).hexdigest() for t in texts])],
                names=["doc_id", "xx", "n_bytes", "h1", "h2", "text_sha256"],
            )

    return run


def _chunks(bits: np.ndarray, mask: int):
    """One row per chunk of each normalised text whose hash is in the table, a text at a time."""

    @frees_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = np.flatnonzero(in_table(batch.column("xx").to_numpy().view(np.uint64), bits, mask))
            for ids, texts, part in doc_batches([batch.take(pa.array(wanted))]):
                for row, text in enumerate(texts):
                    data = normalise(text)
                    cuts = range(0, len(data), CHUNK_BYTES)
                    at = pa.array([row] * len(cuts), pa.int64())
                    parts = pa.array([data[i : i + CHUNK_BYTES] for i in cuts], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(at), part.column("xx").take(at), pa.array(range(len(cuts)), pa.int32()), parts], names=["doc_id", "xx", "chunk_no", "chunk"]
                    )

    return run


def _with_xx(docs: DataFrame) -> DataFrame:
    return id_and_text(docs).withColumn("xx", F.xxhash64(F.coalesce("text", F.lit(""))))


def exact_groups(docs: DataFrame, moduli: tuple[int, int] = MODULI) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, xx (hash of the raw text)."""
    docs = _with_xx(docs)
    marks = cut_lineage(
        docs.mapInArrow(_fingerprints(moduli), _FP).withColumn("rid", F.monotonically_increasing_id()), "op1-fingerprints"
    )
    key = ["n_bytes", "h1", "h2"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid", "xx"))
    groups = cut_lineage(marks.groupBy(*key).agg(F.count("*").alias("size"), first.alias("ref")), "op1-groups")
    tagged = marks.join(groups, key)

    # each (id, raw text) of a group of two or more, and the group's reference once
    shared = groups.where("size > 1 AND n_bytes > 0").withColumn("salts", F.ceil(F.col("size") / SALT_ROWS).cast("int"))
    members = marks.join(shared, key).where("rid != ref.rid").groupBy("doc_id", "xx", F.col("ref.rid").alias("ref_rid"), "salts").agg(
        F.pmod(F.min(F.xxhash64("rid")), F.col("salts")).cast("int").alias("salt")
    )
    references = shared.select(
        F.col("ref.doc_id").alias("doc_id"), F.col("ref.xx").alias("xx"), F.col("ref.rid").alias("ref_rid"), "salts", F.lit(None).cast("int").alias("salt")
    )
    wanted = cut_lineage(members.unionByName(references), "op1-wanted")
    table = docs.sparkSession.sparkContext.broadcast(bit_table(wanted.select("xx")))

    def chunks(batches):
        return _chunks(*table.value)(batches)

    # one pass over the texts serves both kinds; texts outside all groups stay where they are
    found = docs.mapInArrow(chunks, "doc_id long, xx long, chunk_no int, chunk binary")
    found = found.alias("d").join(wanted.alias("w"), F.expr("d.xx = w.xx AND d.doc_id <=> w.doc_id"))
    rows = cut_lineage(found.select("w.*", "chunk_no", "chunk"), "op1-chunks")
    mine = rows.where("salt IS NOT NULL").select("doc_id", "xx", "ref_rid", "salt", "chunk_no", "chunk")
    theirs = rows.where("salt IS NULL").select(
        "ref_rid", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "chunk_no", F.col("chunk").alias("ref_chunk")
    )
    differ = cut_lineage(
        mine.join(theirs, ["ref_rid", "salt", "chunk_no"]).where("chunk != ref_chunk").select("doc_id", "xx").distinct(), "op1-differ"
    )
    if not differ.isEmpty():  # hash collisions: classes by whole text among the rows that differ from the reference
        same = F.expr("t.xx = o.xx AND t.doc_id <=> o.doc_id")
        odd = tagged.alias("t").join(differ.alias("o"), same, "left_semi")
        space = F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", " ")
        texts = odd.alias("t").join(docs.dropDuplicates(["doc_id", "xx"]).alias("o"), same)
        texts = cut_lineage(texts.select("rid", "t.doc_id", "t.xx", *key, space.alias("norm")), "op1-collided")
        classes = texts.groupBy("norm").agg(F.count("*").alias("size2"), first.alias("ref2"))
        found = texts.join(classes, "norm").select("rid", "size2", "ref2")
        lost = texts.groupBy(*key).agg(F.count("*").alias("lost"))
        tagged = tagged.join(lost, key, "left").join(found, "rid", "left")
        tagged = tagged.withColumn("size", F.coalesce("size2", F.col("size") - F.coalesce("lost", F.lit(0)))).withColumn(
            "ref", F.coalesce("ref2", "ref")
        )
    return tagged.select(
        "doc_id", F.col("ref.doc_id").alias("keep_id"), F.col("size").cast("long").alias("group_size"),
        (F.col("rid") == F.col("ref.rid")).alias("kept"), "text_sha256", "xx",
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The input rows that stay, with all their columns."""
    raw = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), raw.alias("raw"))
    kept = exact_groups(docs).where("kept").select(F.col("doc_id").alias("kept_id"), "xx")
    rows = rows.join(kept, (F.col("raw") == F.col("xx")) & F.col("id").eqNullSafe(F.col("kept_id")), "left_semi")
    return rows.dropDuplicates(["id", "raw"]).select("row.*")
