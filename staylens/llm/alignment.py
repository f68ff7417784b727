"""Cross-tokenizer alignment with inverted pair bitmaps.

Two tokenizers cut one string of bytes.  Where an A token and a B token end
together they are linked; these places also cut both into groups.  Every pair
of ids has postings: bitmaps of the documents that hold it linked, one plane
for each binary digit of how often.  OR-merged, the planes' popcount is the
pair's document count; weighted by their digit their popcounts add up to its
link count.  Then the postings are walked the other way and carry the pair's
score to the documents.

Documents are taken in blocks of at most BLOCK_DOCUMENTS, closed after
BLOCK_LINKS links.  A block's planes are compressed: a pair in few of its
documents has a list of 16-bit places, one in many a plain bitmap.  Blocks hold
different documents, so a pair's planes are OR-merged by adding the popcounts
of its blocks, pre-aggregated by pair; no pair's postings are ever in one
place, and a pair of all documents is as many rows as there are blocks.  A
block gets back the scores of its own pairs only.

Neither tokenizer joins anything across a single space between two characters
that are no white space, so texts are cut there and the pieces that come again
are remembered by each worker.

Defined cases: texts null, empty, or that the tokens do not spell byte by byte
have no tokens, zeros and an empty ``groups_sha256``; rows repeated, with one
id or without are rows of their own; an empty table gives no rows; other
columns are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from staylens.llm.common import frees_memory, id_and_text
from staylens.llm.packing import byte_letters
from staylens.session import cut_lineage

BLOCK_DOCUMENTS = 1 << 16
BLOCK_LINKS = 1_500_000
CACHE_PIECES = 300_000  # remembered from block to block
LEARNT = 20_000  # pieces that are aligned at a time
_CUT = re.compile(r"(?<=\S) (?=\S)")
_B_MASK = (1 << 32) - 1


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Tokenizers:
    """Ids and bytes of the tokens of space+text by both tokenizers."""

    def __init__(self, paths: tuple[str, str]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(paths[0]), sentencepiece.SentencePieceProcessor(model_file=paths[1])
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        byte = {letter: b for b, letter in byte_letters().items()}
        vocab = self.a.get_vocab()
        self.a_bytes, self.b_bytes = [b""] * (max(vocab.values()) + 1), []
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        for i in range(self.b.vocab_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.a_size, self.b_size = (np.array([len(x) for x in b], np.int64) for b in (self.a_bytes, self.b_bytes))
        ids = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.written = [i + end for end in ",|;" for i in ids]  # an id inside a side, last of A's side, last of B's
        self.written_size = np.array([len(x) for x in self.written], np.int64)
        self.ids = len(ids)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        found = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        return [e.ids for e in found], self.b.encode(texts, num_threads=1)

    def align(self, texts: list[str]) -> Aligned:
        """The groups of each text, all texts at once."""
        a, b = self.encode(texts)
        n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in (a, b))
        texts = [(" " + t).encode() for t in texts]
        good = np.array([b"".join(map(self.a_bytes.__getitem__, x)) == t and b"".join(map(self.b_bytes.__getitem__, y)) == t for t, x, y in zip(texts, a, b, strict=True)], bool)
        if not good.all():
            a, b = ([x if g else [] for x, g in zip(side, good, strict=True)] for side in (a, b))
            n_a, n_b = n_a * good, n_b * good
        flat_a, flat_b = (np.fromiter(chain.from_iterable(side), np.int64) for side in (a, b))
        end_a, end_b = np.cumsum(self.a_size[flat_a]), np.cumsum(self.b_size[flat_b])
        common = np.intersect1d(end_a, end_b, assume_unique=True)  # texts end here as well
        last_a, last_b = np.searchsorted(end_a, common), np.searchsorted(end_b, common)
        groups = np.diff(np.searchsorted(last_a, np.concatenate(([0], np.cumsum(n_a)))))
        # A's ids of a group, then B's: an id stands behind those of its own side and the other side's of earlier groups
        line = np.empty(len(flat_a) + len(flat_b), np.int64)
        mark_a, mark_b = (np.zeros(len(flat), np.int64) for flat in (flat_a, flat_b))
        mark_a[last_a], mark_b[last_b] = self.ids, 2 * self.ids
        size_a, size_b = (np.diff(last, prepend=-1) for last in (last_a, last_b))
        line[np.arange(len(flat_a)) + np.repeat(np.cumsum(size_b) - size_b, size_a)] = flat_a + mark_a
        line[np.arange(len(flat_b)) + np.repeat(np.cumsum(size_a), size_b)] = flat_b + mark_b
        string = "".join(map(self.written.__getitem__, line.tolist()))
        ends = np.cumsum(self.written_size[line])
        ends = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(n_a + n_b)))].tolist()
        written = [string[s : max(s, e - 1)] for s, e in zip(ends, ends[1:], strict=False)]  # without the last semicolon
        return Aligned(good, n_a, n_b, groups, flat_a[last_a] << 32 | flat_b[last_b], written)


@functools.lru_cache(1)
def loaded(paths: tuple[str, str]) -> Tokenizers:
    """Once a Python worker: a tokenizer leaves some of its memory behind, several MB a task if each task loads its own."""
    return Tokenizers(paths)


class Aligned(NamedTuple):
    good: np.ndarray  # the tokens of both spell the text
    n_a: np.ndarray
    n_b: np.ndarray
    groups: np.ndarray
    pairs: np.ndarray  # the linked ids, of all texts in turn
    written: list[str]


class Pieces(dict):
    """piece of text -> its number; token counts, written groups and linked pairs by that number."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.good, self.written, self.groups, self.more = [], [], [], []

    def learn(self, pieces: list[str]) -> None:
        for start in range(0, len(pieces), LEARNT):
            some = pieces[start : start + LEARNT]
            found = self.tokenizers.align(some)
            self.update(zip(some, range(len(self.good), len(self.good) + len(some)), strict=True))
            self.good += found.good.tolist()
            self.written += found.written
            self.groups += found.groups.tolist()
            self.more.append((found.n_a, found.n_b, found.pairs))

    def columns(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of A and of B and groups of each piece, and the pairs of all in turn."""
        if len(self.more) > 1:
            self.more = [tuple(np.concatenate(c) for c in zip(*self.more, strict=True))]
        n_a, n_b, pairs = self.more[0] if self.more else [np.empty(0, np.int64)] * 3
        return n_a, n_b, np.array(self.groups, np.int64), pairs


class Postings:
    """Planes of the pairs of a block: which documents hold a pair a number of times with this binary digit."""

    def __init__(self, documents: int, planes: list[tuple[bytes, bytes, bytes, bytes]]):
        self.width = -(-documents // 8)
        self.planes = planes

    @classmethod
    def of(cls, documents: int, pair: np.ndarray, doc: np.ndarray, times: np.ndarray) -> Postings:
        """From the different (pair, document), sorted, and how often each occurs."""
        self = cls(documents, [])
        for digit in range(int(times.max(initial=0)).bit_length()):
            held = times >> digit & 1 > 0
            pairs, start, size = np.unique(pair[held], return_index=True, return_counts=True)
            docs = doc[held]
            dense = 2 * size > self.width
            bitmaps = b""
            for s, n in zip(start[dense], size[dense], strict=True):
                bits = np.zeros(8 * self.width, np.uint8)
                bits[docs[s : s + n]] = 1
                bitmaps += np.packbits(bits, bitorder="little").tobytes()
            lists = docs[~np.repeat(dense, size)].astype(np.uint16)
            self.planes.append((pairs[~dense].astype(np.int32).tobytes(), size[~dense].astype(np.int32).tobytes(), lists.tobytes(), pairs[dense].astype(np.int32).tobytes() + bitmaps))
        return self

    def _plane(self, plane: tuple[bytes, bytes, bytes, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Listed pairs, their sizes, their places; pairs with a bitmap, the bitmaps."""
        pairs, size, lists = np.frombuffer(plane[0], np.int32), np.frombuffer(plane[1], np.int32), np.frombuffer(plane[2], np.uint16)
        count = len(plane[3]) // (4 + self.width)
        return pairs, size, lists, np.frombuffer(plane[3][: 4 * count], np.int32), np.frombuffer(plane[3][4 * count :], np.uint8).reshape(count, self.width)

    def walk(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(weight, pair, document) of the postings, a plane or a bitmap at a time."""
        for digit, plane in enumerate(self.planes):
            pairs, size, lists, dense, bitmaps = self._plane(plane)
            yield 1 << digit, np.repeat(pairs, size), lists.astype(np.int64)
            for pair, bits in zip(dense, bitmaps, strict=True):
                docs = np.flatnonzero(np.unpackbits(bits, bitorder="little"))
                yield 1 << digit, np.full(len(docs), pair), docs

    def counts(self, pairs: int) -> tuple[np.ndarray, np.ndarray]:
        """Links and documents of each pair, by popcount of the planes and of their union."""
        links, docs = np.zeros(pairs, np.int64), np.zeros(pairs, np.int64)
        listed, dense_of = [np.empty(0, np.int64)], {}
        for digit, plane in enumerate(self.planes):
            at, size, lists, dense, bitmaps = self._plane(plane)
            links[at] += size.astype(np.int64) << digit
            links[dense] += np.bitwise_count(bitmaps).sum(1, dtype=np.int64) << digit
            listed.append(np.repeat(at.astype(np.int64), size) << 16 | lists)
            for pair, bits in zip(dense.tolist(), bitmaps, strict=True):
                dense_of[pair] = dense_of[pair] | bits if pair in dense_of else bits
        union = np.unique(np.concatenate(listed))
        pair, doc = union >> 16, union & 0xFFFF
        for p, bits in dense_of.items():  # the lists of its other planes are joined to the bitmap
            bits = bits.copy()
            more = doc[slice(*np.searchsorted(pair, [p, p + 1]))]
            np.bitwise_or.at(bits, more >> 3, (1 << (more & 7)).astype(np.uint8))
            docs[p] = np.bitwise_count(bits).sum()
        listed = ~np.isin(pair, np.fromiter(dense_of, np.int64, len(dense_of)))
        docs += np.bincount(pair[listed], minlength=pairs)
        return links, docs


_BLOCK = "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, pairs array<long>, planes array<struct<pairs: binary, sizes: binary, lists: binary, bitmaps: binary>>"
_PLANES = pa.list_(pa.struct([(n, pa.binary()) for n in ("pairs", "sizes", "lists", "bitmaps")]))


class _Block:
    def __init__(self):
        self.ids, self.shas, self.pieces, self.row, self.links = [], [], [], [], 0

    def closed(self, known: Pieces, number: int) -> pa.RecordBatch:
        size = len(self.ids)
        piece = np.concatenate([np.empty(0, np.int64), *self.pieces])
        row = np.repeat(np.array(self.row, np.int64), [len(p) for p in self.pieces])
        n_a, n_b, lengths, linked = known.columns()
        sums = [np.bincount(row, n[piece], size).astype(np.int64) if len(piece) else np.zeros(size, np.int64) for n in (n_a, n_b, lengths)]
        # different (document, piece), then (pair, document), with how often
        both, times = np.unique(row << 32 | piece, return_counts=True)
        row, piece = both >> 32, both & _B_MASK
        many = lengths[piece]
        inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at = np.repeat((np.cumsum(lengths) - lengths)[piece], many) + inner
        pairs, number_of = np.unique(linked[at], return_inverse=True)
        key = number_of << 16 | np.repeat(row, many)
        order = np.argsort(key, kind="stable")
        key, times = key[order], np.repeat(times, many)[order]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
        times = np.add.reduceat(times, starts) if len(key) else times
        postings = Postings.of(size, key[starts] >> 16, key[starts] & 0xFFFF, times)
        planes = [dict(zip(("pairs", "sizes", "lists", "bitmaps"), p, strict=True)) for p in postings.planes]
        columns = [[number], [self.ids], *([s] for s in (sums[0], sums[1], sums[2], sums[2])), [self.shas], [pairs]]
        kinds = [pa.int64(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string()), pa.list_(pa.int64())]
        names = [c.split()[0] for c in _BLOCK.split(", ")[:8]]
        return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), pa.array([planes], _PLANES)], names=[*names, "planes"])


def _blocks(paths: tuple[str, str], documents: int, links: int):
    @frees_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, block, number = Pieces(loaded(paths)), _Block(), TaskContext.get().partitionId() << 32
        step = min(64, documents)
        for batch in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            texts = [_CUT.split(t) if t else [] for t in batch.column("text").to_pylist()]
            known.learn(list(dict.fromkeys(p for pieces in texts for p in pieces if p not in known)))
            for doc_id, pieces in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                at = list(map(known.__getitem__, pieces))
                sha = ""
                if at and all(map(known.good.__getitem__, at)):
                    written = ";".join(map(known.written.__getitem__, at))
                    sha = hashlib.sha256(written.encode()).hexdigest()
                    block.row.append(len(block.ids))
                    block.pieces.append(np.array(at, np.int64))
                    block.links += sum(map(known.groups.__getitem__, at))
                block.ids.append(doc_id)
                block.shas.append(sha)
            if block.links >= links or len(block.ids) + step > documents:
                yield block.closed(known, number)
                block, number = _Block(), number + 1
                if len(known) > CACHE_PIECES:
                    known.forget()
        if block.ids:
            yield block.closed(known, number)

    return run


def _postings(row: dict) -> Postings:
    return Postings(len(row["doc_id"]), [(p["pairs"], p["sizes"], p["lists"], p["bitmaps"]) for p in row["planes"]])


@frees_memory
def _popcounts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(i, 1) for b in batches for i in range(b.num_rows)):
        pairs = batch.column("pairs").flatten()
        row = batch.select(["doc_id", "planes"]).to_pylist()[0]
        links, docs = _postings(row).counts(len(pairs))
        yield pa.RecordBatch.from_arrays([pairs, pa.array(links), pa.array(docs)], names=["pair", "links", "docs"])


@frees_memory
def _returned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The scores that a block's postings carry to its documents."""
    keep = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    for batch in (b.slice(i, 1) for b in batches for i in range(b.num_rows)):
        pairs, scores = batch.column("pairs").flatten().to_numpy(), batch.column("scores").flatten()
        score = np.zeros(len(pairs), np.int64)
        if len(scores):
            score[np.searchsorted(pairs, scores.field("pair").to_numpy())] = scores.field("score").to_numpy()
        count, best = score >> 1, score & 1
        postings = _postings(batch.select(["doc_id", "planes"]).to_pylist()[0])
        size = len(batch.column("doc_id").flatten())
        total, n_best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for weight, pair, doc in postings.walk():
            np.add.at(total, doc, weight * count[pair])
            np.add.at(n_best, doc, weight * best[pair])
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c).flatten() for c in keep), pa.array(n_best), pa.array(total), batch.column("groups_sha256").flatten()],
            names=[*keep, "n_best", "count_sum", "groups_sha256"],
        )


def posting_blocks(docs: DataFrame, paths: tuple[str, str] | None = None, documents: int = BLOCK_DOCUMENTS, links: int = BLOCK_LINKS) -> DataFrame:
    """The written blocks of documents and postings that the other functions read."""
    run = _blocks(paths or tokenizer_paths(), min(documents, 1 << 16), links)
    return cut_lineage(id_and_text(docs).mapInArrow(run, _BLOCK), "op11-blocks")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair (A id times 2**32, plus B id), a, b, links, docs of the whole corpus, and whether it is its B id's most frequent."""
    found = blocks.select("doc_id", "pairs", "planes").mapInArrow(_popcounts, "pair long, links long, docs long")
    found = cut_lineage(found.groupBy("pair").agg(F.sum("links").alias("links"), F.sum("docs").alias("docs")), "op11-pairs")
    found = found.withColumns({"a": F.shiftright("pair", 32).cast("int"), "b": F.col("pair").bitwiseAND(_B_MASK).cast("int")})
    most = found.groupBy("b").agg(F.max("links").alias("most"))
    return found.join(F.broadcast(most), "b").select("pair", "a", "b", "links", "docs", (F.col("links") == F.col("most")).alias("best"))  # a row per B id


def align(docs: DataFrame, paths: tuple[str, str] | None = None, documents: int = BLOCK_DOCUMENTS, links: int = BLOCK_LINKS) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    blocks = posting_blocks(docs, paths, documents, links)
    score = (F.col("links") * 2 + F.col("best").cast("long")).alias("score")
    scores = pair_counts(blocks).select("pair", score)
    wanted = blocks.select("block", F.explode("pairs").alias("pair"))
    got = wanted.join(scores, "pair").groupBy(F.col("block").alias("of")).agg(F.collect_list(F.struct("pair", "score")).alias("scores"))  # a block's pairs
    kinds = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return blocks.join(got, blocks.block == got.of, "left").mapInArrow(_returned, kinds)
