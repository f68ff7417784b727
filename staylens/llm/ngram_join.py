"""N-gram Jaccard join: links texts whose word-shingle sets are alike, by a count-vector R-tree.

Two documents link when 100 * |A and B| >= percent * |A or B| on their sets of
``k``-word shingles.  The result is exact; it is found in stages that never
list the pairs inside a group of copies:

1. Documents with equal sets form one class, represented by its smallest id.
2. Star links: representatives that agree on a band of MinHash values are
   compared with the smallest id of that band, so a group of m near copies
   costs m comparisons.  Verified links give first components.
3. The rest: by prefix filtering, any linked pair shares a shingle among the
   rarest ``n - ceil(percent/100 * n) + 1`` of each set, under one order for
   all documents (a count sketch, then the hash).  A shingle matters only
   if it joins two components, which one pre-aggregated count tells; pairs
   inside a component are never made.
4. In each bucket of such a shingle the documents are points: their shingles
   hashed into GROUPS groups, one count per group.  The points are packed into
   an R-tree by set size; the overlap of two boxes is at most the sum of the
   smaller of their largest counts, the overlap of two points at most the sum
   of coordinate minima.  Boxes, then points, that cannot reach the needed
   overlap are cut.  Large buckets are split into pairs of blocks.
5. Surviving pairs are verified on the whole sets, and components joined.

Defined cases: null or wordless text has an empty set and no links; fewer than
``k`` words make one shingle of them all; rows of one id with equal sets
are one vertex, different sets of one id are vertices of their own; rows without
an id are vertices by their text, link as others do and name no component (null
where all members lack ids); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from staylens.llm.common import Rolling, bit_table, doc_batches, frees_memory, id_and_text, in_table, mix, word_hashes
from staylens.session import cut_lineage, discard

K = 5
PERCENT = 75
GROUPS = 128
BANDS, ROWS = 6, 3
SKETCH = 1 << 20  # slots of the count sketch: 8 MB, the bound of what is broadcast
_SKETCH_BLOCK = 1 << 14
LEAF = 32
BLOCK_ROWS = 2048
SALT_ROWS = 512
_PLAIN = bytes.maketrans(bytes([*range(65, 91), *range(9, 14)]), bytes([*range(97, 123), *[32] * 5]))  # lower case, one white space
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


class Shingles:
    """Sorted distinct 64-bit shingle hashes of a text."""

    def __init__(self, k: int):
        self.k, self.rolling = k, Rolling(0x9E3779B97F4A7C15)

    def of(self, text: bytes) -> np.ndarray:
        hashes = word_hashes(text.translate(_PLAIN))
        n = len(hashes)
        if 0 < n < self.k:  # one shingle, told from longer ones by its length
            return mix(self.rolling.windows(hashes, n) + np.uint64(n))
        found = np.sort(mix(self.rolling.windows(hashes, self.k)))
        return found[np.append(True, found[1:] != found[:-1])] if len(found) else found


def _min_hashes(found: np.ndarray) -> np.ndarray:
    """The least product of a set's shingles with each seed; long sets a part at a time."""
    return np.min([(found[i : i + 4096] * _SEEDS[:, None]).min(1) for i in range(0, len(found), 4096)], axis=0)


def _survey(k: int):
    """Rows of documents (kind 0: size, set signature, bands) and of sketch blocks (kind 1)."""

    @frees_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, sketch = Shingles(k), np.zeros(SKETCH, np.uint32)
        names = ["kind", "doc_id", "n", "s1", "s2", "bands", "block", "counts"]
        for ids, texts, _ in doc_batches(batches):
            n, s1, s2, bands, slots = [], [], [], [], [np.empty(0, np.int64)]
            for text in texts:
                found = shingles.of(text)
                n.append(len(found))
                s1.append(int(found.sum().view(np.int64)) if len(found) else 0)
                s2.append(int(np.bitwise_xor.reduce(mix(found + np.uint64(7))).view(np.int64)) if len(found) else 0)
                if len(found):
                    slots.append((found & np.uint64(SKETCH - 1)).astype(np.int64))
                    low = _min_hashes(found).reshape(BANDS, ROWS)
                    bands.append(mix(low[:, 0] + mix(low[:, 1] + mix(low[:, 2]))).view(np.int64))
                else:
                    bands.append(np.empty(0, np.int64))
            sketch += np.bincount(np.concatenate(slots), minlength=SKETCH).astype(np.uint32)
            m = len(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * m, pa.int32()), ids, pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()),
                 pa.array(bands, pa.list_(pa.int64())), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names
            )
        blocks = [(i, b) for i, b in enumerate(sketch.reshape(-1, _SKETCH_BLOCK)) if b.any()]
        m = len(blocks)
        yield pa.RecordBatch.from_arrays(
            [pa.array([1] * m, pa.int32()), *(pa.nulls(m, pa.int64()) for _ in range(4)), pa.nulls(m, pa.list_(pa.int64())),
             pa.array([i for i, _ in blocks], pa.int32()), pa.array([np.minimum(b, 65535).astype(np.uint16).tobytes() for _, b in blocks], pa.binary())], names=names
        )

    return run


def _sum_block(frame: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(_SKETCH_BLOCK, np.uint64)
    for counts in frame["counts"]:
        total += np.frombuffer(counts, np.uint16)
    total = np.minimum(total, np.uint64(2**32 - 1)).astype(np.uint32)
    return pd.DataFrame({"block": [frame["block"].iloc[0]], "counts": [total.tobytes()]})


def _prefixes(k: int, percent: int, sketch: np.ndarray):
    """Per document: its rarest shingles, and its point (a count per group)."""

    @frees_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(k)
        for ids, texts, _ in doc_batches(batches):
            rows, rare, points = [], [], []
            for row, text in enumerate(texts):
                found = shingles.of(text)
                n = len(found)
                if n:
                    take = n - -(-percent * n // 100) + 1
                    count = sketch[(found & np.uint64(SKETCH - 1)).astype(np.int64)]
                    rows.append(row)
                    rare.append(found[np.argsort(count, kind="stable")[:take]].view(np.int64))  # found is sorted: ties go by hash
                    counts = np.bincount((found >> np.uint64(57)).astype(np.int64), minlength=GROUPS)
                    points.append(counts.astype(np.uint8 if counts.max() < 256 else np.uint32).tobytes())  # the length tells which
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows, pa.int64())), pa.array(rare, pa.list_(pa.int64())), pa.array(points, pa.binary())],
                names=["doc_id", "rare", "point"],
            )

    return run


def _mixed_tokens(bits: np.ndarray, mask: int):
    """A row per rare shingle that is in the table, with its place in the common order."""

    @frees_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            lists = batch.column("rare")
            start = lists.offsets.to_numpy()
            token, start = lists.flatten().to_numpy(), start - start[0]
            row = np.repeat(np.arange(batch.num_rows), np.diff(start))
            pos = np.arange(len(token)) - start[:-1][row]
            hit = np.flatnonzero(in_table(token.view(np.uint64), bits, mask))
            at = pa.array(row[hit])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(at) for c in ("doc_id", "comp")), pa.array(token[hit]), pa.array(pos[hit].astype(np.int32))],
                names=["doc_id", "comp", "token", "pos"],
            )

    return run


class Bucket:
    """Documents as points, sorted by bucket and set size."""

    def __init__(self, table: pa.Table, percent: int):
        self.percent = percent
        self.ids, self.comp, self.n, pos, self.block, lo, hi, token = (
            table[c].to_numpy() for c in ("doc_id", "comp", "n", "pos", "blk", "lo", "hi", "token")
        )
        self.rest = self.n - pos  # shingles from this one on, in the common order
        self.split = lo != hi
        edge = np.flatnonzero((token[1:] != token[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
        self.starts = np.concatenate(([0], edge, [len(token)]))
        points = table["point"].to_pylist()
        if any(len(p) > GROUPS for p in points):
            points = [p if len(p) > GROUPS else np.frombuffer(p, np.uint8).astype(np.uint32).tobytes() for p in points]
        self.points = np.frombuffer(b"".join(points), np.uint32 if points and len(points[0]) > GROUPS else np.uint8).reshape(-1, GROUPS)

    def fit(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs of rows whose sizes and coordinate minima allow a link between components."""
        good = (self.comp[i] != self.comp[j]) & (100 * self.n[i] >= self.percent * self.n[j])
        good &= ~self.split[i] | (self.block[i] != self.block[j])
        # a linked pair's first common shingle leaves enough room behind it in both sets
        good &= (100 + self.percent) * np.minimum(self.rest[i], self.rest[j]) >= self.percent * (self.n[i] + self.n[j])
        i, j = i[good], j[good]
        overlap = np.concatenate([np.minimum(self.points[i[c : c + 8192]], self.points[j[c : c + 8192]]).sum(1, dtype=np.int64) for c in range(0, len(i) + 1, 8192)])
        good = (100 + self.percent) * overlap >= self.percent * (self.n[i] + self.n[j])
        return i[good], j[good]

    def leaves(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs in buckets of one leaf, all such buckets together, by distance in the order."""
        length = np.diff(self.starts)
        small = length <= LEAF
        rows = np.flatnonzero(np.repeat(small, length))
        end = np.repeat(self.starts[1:], length)[rows]
        for step in range(1, LEAF):
            near = rows + step < end
            if not near.any():
                return
            rows, end = rows[near], end[near]
            yield self.fit(rows, rows + step)

    def tree(self, start: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a larger bucket: boxes of LEAF points are joined before their points."""
        cuts = np.arange(start, end, LEAF)
        most = np.stack([self.points[c : min(c + LEAF, end)].max(0) for c in cuts])
        least, largest = self.n[cuts], self.n[np.minimum(cuts + LEAF, end) - 1]
        alone = np.array([(self.comp[c : min(c + LEAF, end)] == self.comp[c]).all() for c in cuts])
        first = self.comp[cuts]
        for a, c in enumerate(cuts):
            may = (100 + self.percent) * np.minimum(most[a], most[a:]).sum(1, dtype=np.int64) >= self.percent * (least[a] + least[a:])
            may &= 100 * largest[a] >= self.percent * least[a:]
            may &= ~(alone[a] & alone[a:] & (first[a] == first[a:]))  # boxes of one and the same component
            for d in cuts[a:][may]:
                i, j = np.meshgrid(np.arange(c, min(c + LEAF, end)), np.arange(d, min(d + LEAF, end)), indexing="ij")
                yield self.fit(*(x[i < j] for x in (i, j)))

    def pairs(self) -> np.ndarray:
        found = [*self.leaves()]
        for start, end in zip(self.starts[:-1], self.starts[1:], strict=True):
            if end - start > LEAF:
                found += self.tree(start, end)
        if not found:
            return np.empty((0, 2), np.int64)
        u, v = (self.ids[np.concatenate(x)] for x in zip(*found, strict=True))
        return np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], 1), axis=0)


def _bucket_pairs(percent: int):
    """Pairs of each bucket (or of two of its blocks); whole buckets only, the last one waits for the next batch."""

    @frees_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(table: pa.Table) -> pa.RecordBatch:
            pairs = Bucket(table, percent).pairs()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        rest = None
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                rest = table if rest is None else pa.concat_tables([rest, table])
                keys = [rest[c].to_numpy() for c in ("token", "lo", "hi")]
                last = np.logical_and.reduce([k == k[-1] for k in keys])
                cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
                if cut:
                    yield out(rest.slice(0, cut))
                    rest = rest.slice(cut)
        if rest is not None:
            yield out(rest)

    return run


def _sets(k: int, bits: np.ndarray, mask: int):
    """Shingle sets of the documents whose id hash is in the table."""

    @frees_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(k)
        for batch in batches:
            wanted = np.flatnonzero(in_table(batch.column("hash").to_numpy().view(np.uint64), bits, mask))
            for ids, texts, _ in doc_batches([batch.take(pa.array(wanted))]):
                yield pa.RecordBatch.from_arrays([ids, pa.array([shingles.of(t).tobytes() for t in texts], pa.binary())], names=["doc_id", "members"])

    return run


def _alike(percent: int):
    @frees_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for row, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(row)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) that link.  A document in many pairs is met by salted parts of them."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    ids = cut_lineage(ids.select("doc_id", F.xxhash64("doc_id").alias("hash")), f"{name}-ids")
    # sets are large: one document in 64 of the others is written with those in pairs
    table = docs.sparkSession.sparkContext.broadcast(bit_table(ids.select("hash"), per_hash=64))
    discard(ids)

    def sets_of(batches):
        return _sets(k, *table.value)(batches)

    found = docs.where("doc_id IS NOT NULL").withColumn("hash", F.xxhash64("doc_id")).mapInArrow(sets_of, "doc_id long, members binary")
    sets = cut_lineage(found, f"{name}-sets")  # where the texts are; a few may be in no pair
    uses = cut_lineage(pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts")), f"{name}-uses")
    hubs = sets.join(uses, sets.doc_id == uses.a).dropDuplicates(["a"]).select(
        "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("members").alias("x")
    )
    ends = pairs.join(uses, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    ends = ends.join(sets.select(F.col("doc_id").alias("b"), F.col("members").alias("y")).dropDuplicates(["b"]), "b")
    both = ends.join(hubs, ["a", "salt"]).select("a", "b", "x", "y")
    links = cut_lineage(both.mapInArrow(_alike(percent), "a long, b long"), f"{name}-links")
    discard(sets, uses)
    return links


def components(links: DataFrame, name: str) -> DataFrame:
    """(id, comp) of every vertex that has a link; comp is the smallest id reachable.

    Each round takes the smallest label among the neighbours and then the
    label of that label, so chains shrink by half; labels are written to the
    shared folder after each round.
    """
    both = cut_lineage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    label = cut_lineage(both.groupBy("a").agg(F.least("a", F.min("b")).alias("c")).withColumnRenamed("a", "id"), f"{name}-label")
    while True:
        other = label.select(F.col("id").alias("b"), F.col("c").alias("near"))
        best = both.join(other, "b").groupBy("a").agg(F.min("near").alias("near"))
        step = label.join(best, label.id == best.a).select("id", F.col("c").alias("was"), F.least("c", "near").alias("c"))
        step = cut_lineage(step, f"{name}-step")
        discard(label)
        up = step.select(F.col("id").alias("c"), F.col("c").alias("top"))
        after = cut_lineage(step.join(up, "c").select("id", "was", F.least("c", "top").alias("c")), f"{name}-label")
        discard(step)
        label = after.select("id", "c")
        if after.where("c != was").isEmpty():
            discard(both)
            return label.select("id", F.col("c").alias("comp"))


def _surveyed(docs: DataFrame, k: int) -> DataFrame:
    kinds = "kind int, doc_id long, n long, s1 long, s2 long, bands array<long>, block int, counts binary"
    return cut_lineage(docs.mapInArrow(_survey(k), kinds), "op3-survey")


def _as_vertices(docs: DataFrame, shared: DataFrame, seed: int) -> DataFrame:
    """With ``vertex``: the id, or where there is none or different sets share it a hash of id and text."""
    own = F.when(F.col("shared_id").isNotNull() | F.col("doc_id").isNull(), F.xxhash64("doc_id", "text", F.lit(seed))).otherwise(F.col("doc_id"))
    return docs.join(shared, F.col("doc_id") == F.col("shared_id"), "left").withColumn("vertex", own).drop("shared_id")


def _clashes(docs: DataFrame, survey: DataFrame) -> tuple[DataFrame, int, DataFrame] | None:
    """None if every row has an id and no two sets share one; else the shared ids, a seed that names every vertex differently, and the id of each vertex."""
    key = F.struct("n", "s1", "s2")
    shared = survey.where("kind = 0 AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("shared_id")).agg(F.min(key).alias("a"), F.max(key).alias("z"))
    shared = cut_lineage(shared.where("a != z").select("shared_id"), "op3-shared")
    if shared.isEmpty() and survey.where("kind = 0 AND doc_id IS NULL AND n > 0").isEmpty():
        return None
    for seed in count():
        names = _as_vertices(docs, shared, seed).select("vertex", F.col("doc_id").alias("own")).distinct()
        names = cut_lineage(names, "op3-vertices")
        if names.groupBy("vertex").count().where("count > 1").isEmpty():
            return shared, seed, names


def jaccard_components(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id."""
    docs = id_and_text(docs)
    survey = _surveyed(docs, k)
    clashes = _clashes(docs, survey)
    if not clashes:
        return _components_of(docs, survey, k, percent)
    return _with_shared_ids(docs, clashes, k, percent).select(F.col("own").alias("doc_id"), "n_shingles", "component_id")


def _with_shared_ids(docs: DataFrame, clashes: tuple[DataFrame, int, DataFrame], k: int, percent: int) -> DataFrame:
    """vertex, own (its id), n_shingles, component_id (the smallest id of the component) of each row."""
    shared, seed, names = clashes
    docs = _as_vertices(docs, shared, seed).select(F.col("vertex").alias("doc_id"), "text")
    rows = _components_of(docs, _surveyed(docs, k), k, percent).select(F.col("doc_id").alias("vertex"), "n_shingles", F.col("component_id").alias("comp"))
    rows = cut_lineage(rows.join(names, "vertex", "left"), "op3-rows")
    least = rows.groupBy("comp").agg(F.min("own").alias("component_id"))
    return rows.join(least, "comp", "left")


def _components_of(docs: DataFrame, survey: DataFrame, k: int, percent: int) -> DataFrame:
    """The components of documents where no two sets share an id."""
    spark = docs.sparkSession
    rows = survey.where("kind = 0").select("doc_id", "n", "s1", "s2", "bands")
    linkable = rows.where("n > 0 AND doc_id IS NOT NULL")
    classes = cut_lineage(
        linkable.groupBy("n", "s1", "s2").agg(F.min(F.struct("doc_id", "bands")).alias("first")).select("n", "s1", "s2", "first.*"), "op3-classes"
    )

    stars = classes.select("doc_id", F.posexplode("bands").alias("band", "key"))
    hubs = cut_lineage(
        stars.groupBy("band", "key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("last")).where("a < last").drop("last"), "op3-hubs"
    )
    # a star's ends must be of like size; the sizes go with them, so no set is written for a pair that can't link
    hubs_n = hubs.join(classes.select(F.col("doc_id").alias("a"), F.col("n").alias("na")), "a")
    stars = stars.join(classes.select("doc_id", F.col("n").alias("nb")), "doc_id")
    fits = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (F.col("a") < F.col("doc_id"))
    pairs = stars.join(hubs_n, ["band", "key"]).where(fits).select("a", F.col("doc_id").alias("b")).distinct()
    pairs = cut_lineage(pairs, "op3-stars")
    discard(hubs)
    stars = verified(docs, pairs, k, percent, "op3-star")
    comps = components(stars, "op3-star")
    discard(pairs, stars)
    heads = classes.join(comps, classes.doc_id == comps.id, "left").select("doc_id", "n", F.coalesce("comp", "doc_id").alias("comp"))
    heads = cut_lineage(heads, "op3-heads")

    sketch = np.zeros(SKETCH, np.uint32)
    blocks = survey.where("kind = 1").select("block", "counts").groupBy("block").applyInPandas(_sum_block, "block int, counts binary")
    for row in blocks.toLocalIterator():
        sketch[row.block * _SKETCH_BLOCK : (row.block + 1) * _SKETCH_BLOCK] = np.frombuffer(row.counts, np.uint32)
    table = spark.sparkContext.broadcast(sketch)

    def prefixes(batches):
        return _prefixes(k, percent, table.value)(batches)

    rare = docs.where("doc_id IS NOT NULL").mapInArrow(prefixes, "doc_id long, rare array<long>, point binary").join(heads, "doc_id")
    rare = cut_lineage(rare.dropDuplicates(["doc_id"]), "op3-rare")
    tokens = rare.select("comp", F.explode("rare").alias("token"))
    mixed = tokens.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo < hi")
    mixed = cut_lineage(mixed.select("token", F.ceil(F.col("size") / BLOCK_ROWS).cast("int").alias("blocks")), "op3-mixed")
    spread = spark.sparkContext.broadcast(bit_table(mixed.select("token")))

    def mixed_tokens(batches):
        return _mixed_tokens(*spread.value)(batches)

    found = rare.select("doc_id", "comp", "rare").mapInArrow(mixed_tokens, "doc_id long, comp long, token long, pos int")
    met = found.join(mixed, "token").join(rare.select("doc_id", "n", "point"), "doc_id")
    met = met.withColumn("blk", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    met = met.select("token", "doc_id", "comp", "n", "pos", "point", "blk", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"))
    met = met.repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi", "n", "doc_id")
    pairs = cut_lineage(met.mapInArrow(_bucket_pairs(percent), "a long, b long").distinct(), "op3-pairs")
    discard(rare, mixed, comps)
    late = verified(docs, pairs, k, percent, "op3-late")

    head = heads.select(F.col("doc_id").alias("h"), "comp")
    bridges = late.join(head, late.a == head.h).select("b", F.col("comp").alias("ca")).join(head, F.col("b") == head.h)
    bridges = cut_lineage(bridges.select(F.col("ca").alias("a"), F.col("comp").alias("b")).where("a != b").distinct(), "op3-bridges")
    joined = components(bridges, "op3-late")
    final = heads.join(joined, heads.comp == joined.id, "left").select("doc_id", F.coalesce(joined.comp, heads.comp).alias("comp"))
    named = classes.select("n", "s1", "s2", "doc_id").join(final, "doc_id").select("n", "s1", "s2", "comp")
    named = cut_lineage(named, "op3-named")
    discard(classes, heads, pairs, late, bridges, joined)
    return rows.join(named, ["n", "s1", "s2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("comp")).otherwise(F.col("doc_id")).alias("component_id")
    )



def keep_one_of_each(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """The rows of the smallest id of each component, and rows without an id, with all their columns."""
    texts = id_and_text(docs)
    survey = _surveyed(texts, k)
    clashes = _clashes(texts, survey)
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    if clashes:
        found = _with_shared_ids(texts, clashes, k, percent).where("own != component_id").select(F.col("vertex").alias("gone")).distinct()
        rows = _as_vertices(rows, *clashes[:2])
    else:
        found = _components_of(texts, survey, k, percent).where("doc_id != component_id").select(F.col("doc_id").alias("gone"))
        rows = rows.withColumn("vertex", F.col("doc_id"))
    return rows.select("row", "vertex").join(found, F.col("vertex") == F.col("gone"), "left_anti").select("row.*")
