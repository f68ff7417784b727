"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Every source gets a share of all words in proportion to its weight, at most
REPEAT times what it holds; what is above is shared again by weight.  Words are
dealt in blocks of equal size.  Sainte-Lague gives the blocks to sources by
their highest quotients, target / (2 b + 1), and then the blocks of a source
to its shards (hash ranges of its documents) by the shards' sizes, so each
shard has an integer quota that it fills on its own.

Inside a shard the documents stand in a seeded order and their words form a
stream cut into blocks.  A quota of q blocks over a stream of n is q div n
whole passes and a seeded selection of q mod n blocks: block b is taken if
(b * step + offset) mod n is below the rest, which picks exactly that many
without a sort.  A document takes the words it has in the taken blocks.

A mix of whole documents (``mixed_documents``) fills the same quotas: a source's
blocks are whole passes over the source and a rest.  Documents with more than a
LONG-th of the source's words are dealt first: in seeded order, one is taken if
that brings their words nearer to their share of the rest.  What is still missing
is dealt in blocks to the shards of the others, again by highest quotients.  A
shard takes the documents that end within its quota; the one that crosses it is
left to the source, which goes through its shards once and takes each such
document that brings the words nearer to the quotas.  So a source is off its
quota by half a short document, or, where its long ones leave too little to
make up with, by at most half a long one; a quota is within a block (at most
BLOCK words) of its target.

Only one row a source reaches the driver.  Quotas of shards, long documents and
crossing documents are dealt in one task a source, of at most SHARDS + LONG rows,
and reach the documents by a join on (source, shard), the keys that the documents
are already sorted by.

Defined cases: null text has size 0 and takes 0; the null source is a source
of its own, last in order; a null ``doc_id`` orders first in its shard and is
otherwise ordinary; repeated rows each count (whole documents: all or none of
them are taken); no words or no rows give targets
of 0; columns other than doc_id, text and source are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from staylens.session import cut_lineage

WEIGHTS = (5, 2, 1)
REPEAT = 3
SHARD_ROWS = 20_000
SHARDS = 4096
LONG = 1000
BLOCK = 64  # words in a block, at most
BLOCKS = 1 << 20  # blocks of a mix small enough to have shorter ones
_WORD = "[^\\x20\\x09-\\x0D]+"


def capped_targets(sizes: Sequence[int], weights: Sequence[int], repeat: int = REPEAT) -> list[float]:
    """Targets that sum to the whole, by weight, none above ``repeat`` times its size.

    Sources are settled in order of repeat * size / weight: once the smallest of
    these reaches its share of what is left, so does every later one.
    """
    left, weight = Fraction(sum(sizes)), sum(weights)
    targets = [Fraction(0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: Fraction(repeat * sizes[i], weights[i])):
        targets[i] = min(Fraction(repeat * sizes[i]), left * weights[i] / weight)
        left, weight = left - targets[i], weight - weights[i]
    return [float(t) for t in targets]


def sainte_lague(shares: Sequence[float], seats: int, most: Sequence[int] | None = None) -> list[int]:
    """Seats by highest quotients share / (2 s + 1), no party above ``most``; ties go to the earlier party.

    The quotients above a price x number round(share / (2 x)) for each party;
    the price is bisected, and the last seats are dealt one at a time.
    """
    share = np.maximum(np.asarray(shares, float), 0)
    top = np.asarray([seats] * len(share) if most is None else most, np.int64)
    seats = int(min(seats, top[share > 0].sum()))
    if seats <= 0 or not len(share):
        return [0] * len(share)
    have = lambda x: np.minimum(np.floor(share / (2 * x) + 0.5), top)
    low, high = share[share > 0].min() / (4.0 * (seats + 1)), share.max() + 1.0
    while have(low).sum() < seats:
        low /= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if have(mid).sum() >= seats else (low, mid)
    won = have(high).astype(np.int64)
    while won.sum() < seats:
        quotient = np.where(won < top, share / (2 * won + 1), -1.0)
        won[int(np.argmax(quotient))] += 1
    return won.tolist()


def _step(n: int, seed: int) -> int:
    """A step that visits every one of n blocks."""
    step = (0x9E3779B1 * (2 * seed + 1)) % n or 1
    while math.gcd(step, n) != 1:
        step += 1
    return step


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, key (a source's name, never null), size, xx (a hash of the text), mark and shard of each row."""
    size = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_WORD), F.lit(0))).cast("long")
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64("text").alias("xx"))
    rows = rows.withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    rows = cut_lineage(rows.withColumn("mark", F.xxhash64("doc_id", "xx", F.lit(seed))), "op9-sizes")
    shards = max(1, min(SHARDS, rows.count() // SHARD_ROWS + 16))
    return rows.withColumn("shard", F.pmod("mark", F.lit(shards)).cast("int"))


def _by_shard(rows: DataFrame) -> DataFrame:
    """key, source, shard, words."""
    return rows.groupBy("key", "source", "shard").agg(F.sum("size").alias("words"))


def _quotas(shards: DataFrame, weights: Sequence[int], repeat: int) -> DataFrame:
    """One row per source: key, source_size, target, block, and quota: its blocks by highest quotients."""
    held = shards.groupBy("key", "source").agg(F.sum("words").alias("words")).collect()  # one row a source
    held.sort(key=lambda r: (r.source is None, r.source))
    sizes = [r.words for r in held]
    targets = capped_targets(sizes, [weights[i % len(weights)] for i in range(len(held))], repeat)
    total = sum(sizes)
    block = max(1, min(BLOCK, total // BLOCKS))
    blocks = sainte_lague(targets, round(total / block)) if total else [0] * len(held)
    rows = [(r.key, r.words, target, block, quota) for r, target, quota in zip(held, targets, blocks, strict=True)]
    return shards.sparkSession.createDataFrame(rows, "key string, source_size long, target double, block long, quota long")


def _deal(own: pd.DataFrame, repeat: int, seed: int) -> pd.DataFrame:
    """The blocks of one source dealt to its shards: whole passes, rest, step and offset."""
    own = own.sort_values("shard")
    block = int(own["block"].iloc[0])
    counts = [-(-int(w) // block) for w in own["words"]]
    won = sainte_lague(own["words"].tolist(), int(own["quota"].iloc[0]), [repeat * c for c in counts])
    parts = []
    for shard, n, q in zip(own["shard"], counts, won, strict=True):
        n = max(n, 1)
        parts.append((n, q // n, q % n, _step(n, seed), (seed * 7919 + int(shard) * 104729) % n))
    parts = pd.DataFrame(parts, columns=["blocks", "passes", "rest", "step", "offset"])
    return pd.concat([own[["key", "shard", "source_size", "target", "block"]].reset_index(drop=True), parts], axis=1)


def mix_words(docs: DataFrame, weights: Sequence[int] = WEIGHTS, repeat: int = REPEAT, seed: int = 0) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (and source, xx: a hash of the text)."""
    rows = _sized(docs, seed)
    shards = cut_lineage(_by_shard(rows), "op9-shards")
    kinds = "key string, shard int, source_size long, target double, block long, blocks long, passes long, rest long, step long, offset long"
    dealt = shards.join(_quotas(shards, weights, repeat), "key").groupBy("key").applyInPandas(lambda own: _deal(own, repeat, seed), kinds)

    order = Window.partitionBy("key", "shard").orderBy("mark", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("stop", F.sum("size").over(order)).join(dealt, ["key", "shard"])
    first, last = F.expr("(stop - size) div block"), F.expr("(stop - 1) div block")
    part = F.aggregate(
        F.when(F.col("size") > 0, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")),
        F.lit(0).cast("long"),
        lambda total, b: total + F.when(
            (b * F.col("step") + F.col("offset")) % F.col("blocks") < F.col("rest"),
            F.least((b + 1) * F.col("block"), F.col("stop")) - F.greatest(b * F.col("block"), F.col("stop") - F.col("size")),
        ).otherwise(F.lit(0)),
    )
    taken = F.col("passes") * F.col("size") + part
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "xx")


def _nearest(sizes: Sequence[int], share: float) -> list[bool]:
    """Which of the sizes, one after the other, bring their sum nearer to ``share``."""
    taken, words = [], 0
    for size in sizes:
        taken.append(bool(words + size / 2 <= share))
        words += size * taken[-1]
    return taken


def _deal_whole(own: pd.DataFrame, repeat: int) -> pd.DataFrame:
    """Turns of one source's long documents, and passes and quota in words of the shards of the others.

    Every row has the source's leftover: quota words that no shard got, or more than it got.
    """
    size, block = int(own["source_size"].iloc[0]), int(own["block"].iloc[0])
    passes, rest = divmod(min(int(own["quota"].iloc[0]) * block, repeat * size), size)
    big = own[own["shard"] < 0].sort_values(["mark", "known", "id", "xx"])
    small = own[own["shard"] >= 0].sort_values("shard")
    taken = _nearest(big["words"].tolist(), rest * int(big["words"].sum()) / size)
    left = rest - int(big["words"][taken].sum())
    words = small["words"].tolist()
    won = sainte_lague(words, max(0, round(left / block)), [-(-int(w) // block) for w in words])
    quota = [min(int(w), n * block) for w, n in zip(words, won, strict=True)]
    turns = np.array([passes + t for t in taken], np.int64)
    out = pd.concat([big.assign(turns=turns, fill=0), small.assign(turns=passes, fill=np.array(quota, np.int64))])
    return out.assign(left=left - sum(quota))[["key", "shard", "mark", "known", "id", "xx", "turns", "fill", "left"]]


def _cross(own: pd.DataFrame) -> pd.DataFrame:
    """Which crossing documents of one source are taken, shard by shard."""
    own = own.sort_values("shard")
    missing, again = int(own["left"].iloc[0]), []
    for fill, before, size in zip(own["fill"], own["before"], own["size"], strict=True):
        missing += int(fill) - int(before)
        again.append(size / 2 <= missing)
        missing -= int(size) * again[-1]
    return own.assign(again=np.array(again, bool))[["key", "shard", "again"]]


def whole_turns(docs: DataFrame, weights: Sequence[int] = WEIGHTS, repeat: int = REPEAT, seed: int = 0) -> DataFrame:
    """source, doc_id, xx, turns: how often a mix of whole documents reads each different row."""
    rows = _sized(docs, seed).groupBy("key", "source", "doc_id", "xx", "mark", "shard").agg(F.sum("size").alias("size")).where("size > 0")
    rows = cut_lineage(rows, "op9-rows")
    sources = cut_lineage(_quotas(cut_lineage(_by_shard(rows), "op9-shards"), weights, repeat), "op9-sources")
    rows = rows.join(sources.select("key", "source_size"), "key")
    is_long = F.col("size") * LONG > F.col("source_size")
    lengthy, rows = rows.where(is_long), rows.where(~is_long)  # under LONG rows a source are long

    known, none = F.col("doc_id").isNotNull(), F.lit(0).cast("long")
    big = lengthy.select("key", F.lit(-1).alias("shard"), F.col("size").alias("words"), "mark", known.alias("known"), F.coalesce("doc_id", none).alias("id"), "xx")
    small = _by_shard(rows).select("key", "shard", "words", none.alias("mark"), F.lit(False).alias("known"), none.alias("id"), none.alias("xx"))
    kinds = "key string, shard int, mark long, known boolean, id long, xx long, turns long, fill long, left long"
    dealt = big.unionByName(small).join(sources, "key").groupBy("key").applyInPandas(lambda own: _deal_whole(own, repeat), kinds)
    dealt = cut_lineage(dealt, "op9-dealt")

    order = Window.partitionBy("key", "shard").orderBy("mark", "doc_id", "xx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("before", F.sum("size").over(order) - F.col("size"))
    rows = rows.join(dealt.where("shard >= 0").select("key", "shard", "turns", "fill", "left"), ["key", "shard"])
    rows = cut_lineage(rows.select("key", "shard", "source", "doc_id", "xx", "size", "before", "turns", "fill", "left"), "op9-fill")
    inside = F.col("before") + F.col("size") <= F.col("fill")
    crossing = ~inside & (F.col("before") <= F.col("fill"))  # the first document past the quota, one a shard at most
    again = rows.where(crossing).groupBy("key").applyInPandas(_cross, "key string, shard int, again boolean")
    rows = rows.join(again, ["key", "shard"], "left")
    more = inside | (crossing & F.coalesce("again", F.lit(False)))
    rows = rows.select("source", "doc_id", "xx", (F.col("turns") + more.cast("long")).alias("turns"))

    lengthy = dealt.where("shard < 0").select(
        F.when(F.col("key") != "", F.expr("substr(key, 2)")).alias("source"), F.when(F.col("known"), F.col("id")).alias("doc_id"), "xx", "turns"
    )
    return rows.unionByName(lengthy)


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, repeat: int = REPEAT, seed: int = 0) -> DataFrame:
    """The input rows, each as many times as the mix of whole documents reads it, with all columns."""
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.col("source").cast("string").alias("s"), F.xxhash64("text").alias("mark"))
    turns = whole_turns(docs, weights, repeat, seed).where("turns > 0")
    rows = rows.join(turns, F.expr("mark = xx AND id <=> doc_id AND s <=> source"))
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("turns").cast("int")))).select("row.*")
