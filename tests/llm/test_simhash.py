"""SimHash near-dedup against comparing every pair of fingerprints."""

import random

import pytest
import xxhash

from staylens.llm import queries, simhash
from staylens.llm.ngram_join import components

SCHEMA = "doc_id long, text string, lang string, fingerprint string, print long, key long"


def brute_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, radius=2):
    """The smallest index of each index's component."""
    label = list(range(len(values)))
    moved = True
    while moved:
        moved = False
        for i, x in enumerate(values):
            for j, y in enumerate(values):
                if label[j] < label[i] and (x ^ y).bit_count() <= radius:
                    label[i], moved = label[j], True
    return label


def texts():
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [" ".join(r.choice(vocabulary) for _ in range(n)) for n in (1, 2, 3, 4, 40, 300, 900, 900)]
    out = [None, "", " \n\t ", *base, *base]
    for text in base[5:]:
        for edits in (1, 1, 2, 4, 9):
            words = text.split()
            for _ in range(edits):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            out.append("\n ".join(words).upper())
    return [*out, "é" * 50_000, "no\xa0break x y", "A b\x0bc  d", "a B c d"]


def test_masks_cover_every_pair_within_the_radius():
    for radius in (2, 4):
        masks = simhash.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1 and all(24 <= m.bit_count() <= 40 for m in masks)
        r = random.Random(radius)
        for _ in range(3000):
            flips = sum({1 << r.randrange(64) for _ in range(radius)})
            assert any(not flips & m for m in masks)
    masks = simhash.covering_masks(2)
    assert all(any(not (1 << i | 1 << j) & m for m in masks) for i in range(64) for j in range(64))


@pytest.mark.parametrize("bucket", [128, 1])
def test_components_match_all_pairs(spark, bucket):
    rows = [(i * 3 if i % 7 else None, t, "en", "x", 1, 2) for i, t in enumerate(texts())]
    rows += [(9, "two rows of one id", None, None, None, None)]
    got = simhash.simhash_components(spark.createDataFrame(rows, SCHEMA), bucket=bucket).collect()
    prints = [brute_print(r[1]) for r in rows]
    labels = brute_components(prints)
    ids = {}
    for label, r in zip(labels, rows):
        ids.setdefault(label, []).append(r[0])
    want = [(r[0], f"{p:016x}", min((i for i in ids[x] if i is not None), default=None)) for r, p, x in zip(rows, prints, labels)]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert len({w[2] for w in want}) < len({w[1] for w in want})  # some link without being equal


@pytest.mark.parametrize("bucket", [1, 8, 10_000])
def test_buckets_of_all_sizes_give_the_same_components(spark, bucket):
    r = random.Random(5)
    values = set()
    for _ in range(6):
        centre = r.getrandbits(64)
        values |= {centre ^ sum({1 << r.randrange(64) for _ in range(r.randrange(6))}) for _ in range(60)}
    values |= {0, 1, 3, 7, (1 << 64) - 1, 1 << 63}
    values = [simhash._signed(v) for v in sorted(values)]
    links = simhash.close_links(spark.createDataFrame([(v,) for v in values], "print long"), 2, bucket)
    found = {x.id: x.comp for x in components(links, "test").collect()}
    masked = [v & (1 << 64) - 1 for v in sorted(values)]
    want = [sorted(values)[i] for i in brute_components(masked)]
    assert [found.get(v, v) for v in sorted(values)] == want
    assert links.count() <= 7 * 28 * len(values)


def test_empty_table_and_odd_radius(spark):
    empty = spark.createDataFrame([], SCHEMA)
    out = simhash.simhash_components(empty)
    assert out.columns == ["doc_id", "fingerprint", "component_id"] and out.count() == 0
    with pytest.raises(ValueError, match="even"):
        simhash.close_links(empty, 3)


def test_query_reads_whole_table(spark, tmp_path):
    rows = [(i, t, "en") for i, t in enumerate(texts())]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op13_simhash_dedup"](spark, str(tmp_path)).collect()}
    prints = [brute_print(t) for _, t, _ in rows]
    assert got == {i: (f"{p:016x}", c) for i, (p, c) in enumerate(zip(prints, brute_components(prints)))}
