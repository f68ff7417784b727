"""Cross-tokenizer alignment against both tokenizers on whole texts and a plain count of pairs."""

import collections
import hashlib
import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from conftest import SMOKE
from staylens.llm import alignment, queries
from staylens.llm.common import documents

SCHEMA = "doc_id long, text string, pairs string, block long, lang string"


@pytest.fixture(scope="module")
def tokenizers():
    return alignment.Tokenizers(alignment.tokenizer_paths())


def groups_of(tokenizers, text):
    """[(A ids, B ids)] of a text, or None."""
    if not text:
        return None
    a = tokenizers.a.encode(" " + text, add_special_tokens=False).ids
    b = tokenizers.b.encode(text)
    at_a = np.cumsum([len(tokenizers.a_bytes[i]) for i in a]).tolist()
    at_b = np.cumsum([len(tokenizers.b_bytes[i]) for i in b]).tolist()
    whole = (" " + text).encode()
    if b"".join(tokenizers.a_bytes[i] for i in a) != whole or b"".join(tokenizers.b_bytes[i] for i in b) != whole:
        return None
    out, last_a, last_b = [], 0, 0
    for end in sorted(set(at_a) & set(at_b)):
        i, j = at_a.index(end) + 1, at_b.index(end) + 1
        out.append((a[last_a:i], b[last_b:j]))
        last_a, last_b = i, j
    return out


def expected(tokenizers, rows):
    found = [groups_of(tokenizers, r[1]) or [] for r in rows]
    count = collections.Counter((a[-1], b[-1]) for groups in found for a, b in groups)
    most = collections.Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for row, groups in zip(rows, found):
        links = [(a[-1], b[-1]) for a, b in groups]
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((row[0], sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
                    sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(written.encode()).hexdigest() if groups else ""))
    return out, found


def texts():
    r = random.Random(4)
    parts = ["the ", "word", " is", "\n", "\t", "  ", " ", "é", "ß.", "don't", "'s", "12345", "3.14", "<|endoftext|>", "<s>", "</s>", "<0x0A>", " ", " ", "▁", "\x1c",
             "漢字", "😀", "é", "\x00", "ation", "Unspeakably", "!?", "　", "﻿", "ﬁ"]
    out = [None, "", " ", "\n", "a", " lead", "trail ", "two  gaps", "x" * 4000, "ab " * 3000, "▁ b", "a▁ b"]
    out += ["".join(r.choice(parts) for _ in range(r.randrange(1, 30))) for _ in range(250)]
    out += ["the word is the word"] * 40 + ["the word"] * 30  # pairs that most documents hold
    return out


def key(row):
    return tuple((x is None, x) for x in row)


@pytest.mark.parametrize("limits", [(1 << 16, 1_500_000), (64, 400), (1, 1)])
def test_alignment_matches_whole_texts(spark, tokenizers, limits):
    rows = [(i if i % 9 else None, t, "clash", 7, None) for i, t in enumerate(texts())] + [(5, "another row of this id", None, None, None)] * 2
    got = alignment.align(spark.createDataFrame(rows, SCHEMA).repartition(3), documents=limits[0], links=limits[1]).collect()
    want, found = expected(tokenizers, rows)
    assert sum(not g and bool(r[1]) for g, r in zip(found, rows)) > 5  # some texts that B can't spell
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_pair_counts_by_popcount(spark, tokenizers):
    rows = [(i, t) for i, t in enumerate(texts())]
    links, docs = collections.Counter(), collections.Counter()
    for _, t in rows:
        mine = collections.Counter((a[-1], b[-1]) for a, b in groups_of(tokenizers, t) or [])
        links.update(mine)
        docs.update(mine.keys())
    blocks = alignment.posting_blocks(spark.createDataFrame(rows, "doc_id long, text string"), documents=128)
    got = {(r.a, r.b): (r.links, r.docs, r.best) for r in alignment.pair_counts(blocks).collect()}
    most = {b: max(n for (_, x), n in links.items() if x == b) for _, b in links}
    assert got == {p: (links[p], docs[p], links[p] == most[p[1]]) for p in links}


def test_planes_hold_lists_and_bitmaps():
    r = np.random.default_rng(2)
    for documents_, pairs in ((1, 1), (40, 3), (3000, 50)):
        held = r.random((pairs, documents_)) < r.random((pairs, 1)) ** 3
        times = held * r.integers(1, 40, (pairs, documents_))
        pair, doc = np.nonzero(times)
        postings = alignment.Postings.of(documents_, pair, doc, times[pair, doc])
        again = np.zeros_like(times)
        for weight, p, d in postings.walk():
            np.add.at(again, (p, d), weight)
        links, docs = postings.counts(pairs)
        assert (again == times).all() and (links == times.sum(1)).all() and (docs == held.sum(1)).all()
        if documents_ == 3000:
            assert any(p[2] for p in postings.planes) and any(p[3] for p in postings.planes)


def test_tasks_of_a_worker_share_the_tokenizers(monkeypatch):
    made = []

    class Counted(alignment.Tokenizers):
        def __init__(self, paths):
            made.append(paths)
            super().__init__(paths)

    monkeypatch.setattr(alignment, "Tokenizers", Counted)
    monkeypatch.setattr(alignment, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    paths = tuple(alignment.tokenizer_paths())
    for text in ("the word is", "the word is", "another word"):
        batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1], pa.int64()), "text": [text]})
        assert [b.num_rows for b in alignment._blocks(paths, 8, 100)(iter([batch]))] == [1]
    assert len(made) <= 1


def test_query_and_empty_table(spark, tokenizers):
    rows = [(r.doc_id, r.text) for r in documents(spark, SMOKE).collect()]
    got = queries.QUERIES["op11_token_alignment"](spark, SMOKE).collect()
    assert sorted(map(tuple, got)) == sorted(expected(tokenizers, rows)[0])
    empty = alignment.align(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and empty.columns[0] == "doc_id"
