"""SimHash near-dedup by covering locality-sensitive hashing.

A text's fingerprint has 64 bits: bit i is 1 if it is set in over half the
XXH64 hashes of the text's word shingles, repeats included.  Texts link when
their fingerprints differ in at most ``radius`` bits.

Each bit position gets a non-zero vector of radius + 1 bits, in turn, so that
every vector has as many positions as any other.  There is a table for each
non-zero vector v; its mask holds the positions whose vector has odd overlap
with v.  The vectors of ``radius`` differing positions span less than the whole
space, so some v has even overlap with all of them: under that mask the two
fingerprints are equal.  So every pair within the radius meets in some table,
by construction and not by chance.

Only different fingerprints go to the tables.  Buckets of up to BUCKET of them
are compared in tasks, each giving a star per component, not its pairs.  In a
larger bucket each fingerprint is sent to what it becomes by flipping up to
radius / 2 of the positions outside the mask.  Two that meet there are within
the radius, and any two within the radius meet half way; a meeting place holds
no more fingerprints than there are such flips, so it is a small star again.
The cost is linear in the bucket, however large.

Defined cases: null or wordless text has fingerprint zero and links like any
other; fewer words than ``k`` make one shingle; rows repeated or with one id
are rows of their own; a null id links as others do and is no component's
name unless all its members lack ids; an empty table gives no rows; other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from staylens.llm.common import doc_batches, id_and_text
from staylens.llm.ngram_join import components
from staylens.session import cut_lineage, discard

K = 3
RADIUS = 2  # even
SEED = 42
BITS = 64
BUCKET = 128
_CHUNK = 1 << 15  # shingles whose bits are counted at a time
_UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_hashes(text: bytes, k: int = K) -> list[int]:
    words = text.translate(_UPPER).split()
    if not words:
        return []
    joined, ends, at = b" ".join(words), [], -1
    for word in words:
        at += 1 + len(word)
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[min(k, len(ends)) - 1 :], strict=False)]


def fingerprint(hashes: list[int]) -> int:
    """Bits set in over half the hashes, as an unsigned number; 0 without hashes."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        part = np.array(hashes[i : i + _CHUNK], np.uint64)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _prints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, _ in doc_batches(batches):
            prints = [_signed(fingerprint(shingle_hashes(t, k))) for t in texts]
            yield pa.RecordBatch.from_arrays([ids, pa.array(prints, pa.int64())], names=["doc_id", "print"])

    return run


def covering_masks(radius: int) -> list[int]:
    """A mask per non-zero vector of radius + 1 bits."""
    vectors = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(BITS) if ((i % vectors + 1) & v).bit_count() % 2) for v in range(1, vectors + 1)]


def _stars(radius: int):
    """Links (smallest of the component, other) in each bucket, a list of different fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("prints")
            cuts, values = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy()
            size = np.diff(cuts)
            two = cuts[:-1][size == 2]
            x, y = values[two], values[two + 1]
            near = np.bitwise_count((x ^ y).view(np.uint64)) <= radius
            a, b = [np.minimum(x, y)[near]], [np.maximum(x, y)[near]]
            for start, end in zip(cuts[:-1][size > 2], cuts[1:][size > 2], strict=True):
                x = np.sort(values[start:end])
                near = np.bitwise_count((x[:, None] ^ x[None, :]).view(np.uint64)) <= radius
                if near.sum() == len(x):
                    continue
                label, was = np.arange(len(x)), None
                while was is None or (label != was).any():
                    label, was = np.where(near, label, len(x)).min(1), label
                other = label != np.arange(len(x))
                a.append(x[label[other]])
                b.append(x[other])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (a, b)], names=["a", "b"])

    return run


def close_links(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between the different fingerprints of the column ``print``.

    Their components are those of all pairs within ``radius`` bits.
    """
    if radius % 2:
        raise ValueError(f"radius must be even, not {radius}")
    masks = [_signed(m) for m in covering_masks(radius)]
    tables = F.explode(F.array(*(F.struct(F.lit(m).alias("mask"), F.col("print").bitwiseAND(m).alias("key")) for m in masks)))
    keyed = prints.select("print", tables.alias("t")).select("print", "t.*")
    sizes = keyed.groupBy("mask", "key").agg(F.count("*").alias("size")).where("size > 1")
    met = cut_lineage(keyed.join(sizes, ["mask", "key"]), "op13-met")  # one row of sizes a bucket: a hot one streams through

    small = met.where(F.col("size") <= bucket).groupBy("mask", "key").agg(F.collect_list("print").alias("prints"))
    links = small.select("prints").mapInArrow(_stars(radius), "a long, b long")

    flips = [_signed(sum(1 << i for i in c)) for n in range(radius // 2 + 1) for c in combinations(range(BITS), n)]
    outside = F.filter(F.array(*map(F.lit, flips)), lambda flip: flip.bitwiseAND(F.col("mask")) == 0)
    there = met.where(F.col("size") > bucket).select("print", F.explode(outside).alias("flip"))
    there = there.select("print", F.col("print").bitwiseXOR(F.col("flip")).alias("place"))
    stars = there.groupBy("place").agg(F.min("print").alias("a"), F.collect_set("print").alias("members"))  # no more than there are flips
    stars = stars.select("a", F.explode("members").alias("b")).where("a != b")
    found = cut_lineage(links.unionByName(stars).distinct(), "op13-links")
    discard(met)
    return found


def simhash_components(docs: DataFrame, k: int = K, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    rows = cut_lineage(id_and_text(docs).mapInArrow(_prints(k), "doc_id long, print long"), "op13-prints")
    prints = cut_lineage(rows.groupBy("print").agg(F.min("doc_id").alias("least")), "op13-classes")
    links = close_links(prints, radius, bucket)
    comps = components(links, "op13")
    named = prints.join(comps, prints["print"] == comps.id, "left").select("print", F.coalesce("comp", "print").alias("comp"), "least")
    named = cut_lineage(named, "op13-named")
    discard(prints, links)
    names = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = named.join(names, "comp").select("print", "component_id")
    return rows.join(named, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
