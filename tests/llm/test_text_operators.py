"""The text operators against brute force, on small tables with the awkward cases."""

import collections
import hashlib
import random
import re
import shutil
import tracemalloc
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SMOKE
from staylens.llm import common, exact_dedup, language, merkle, mixing, ngram_join, packing, pii, quality, queries, substring_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BASE = " ".join(f"w{i}" for i in range(70))
TEXTS = [
    BASE, BASE, BASE.replace(" ", "\n"), "x y z " + BASE + " tail", BASE.replace("w35 ", "other "), "", None, "  ", "one two", "one two", "ONE two",
    "a" * 300_000, "no\xa0break é. Second sentence!\nline two", BASE.upper(),
]


def table(spark, texts=TEXTS, extra=()):
    rows = [(i * 3, t, "en" if i % 2 else None, "ab"[i % 2] if i % 5 else None, None) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *extra], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_exact_dedup_matches_brute_force_also_with_colliding_hashes(spark):
    docs = table(spark)
    norm = {r.doc_id: re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in docs.collect()}
    groups = collections.defaultdict(list)
    for i, t in norm.items():
        groups[t].append(i)
    for moduli in (exact_dedup.MODULI, (3, 2)):
        got = by_id(exact_dedup.exact_groups(docs, moduli))
        for i, t in norm.items():
            want = (min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest())
            assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == want


def test_chunk_hashes_combine_in_any_grouping():
    data, m = bytes(range(256)) * 700, exact_dedup.MODULI[0]
    powers = exact_dedup._powers(m)
    a, b = exact_dedup.chunk_hashes(data[:1000], m, powers), exact_dedup.chunk_hashes(data[1000:], m, powers)
    total = (0, 0)
    for piece in a + b:
        total = exact_dedup.combine(total, piece, m)
    assert total == (exact_dedup.fingerprint(data, m, powers), len(data))


def test_dropping_copies_keeps_columns_and_repeated_rows_once(spark):
    docs = table(spark, extra=[(0, BASE, None, "a", None), (None, "no id", None, None, 5)])
    docs = docs.withColumns({"kept": F.lit(1), "xx": F.lit("clash"), "row": F.lit(2)})
    out = exact_dedup.drop_exact_copies(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert sorted(ids, key=lambda x: (x is None, x)) == [0, 9, 12, 15, 21, 24, 30, 33, 36, 39, None]


def test_substring_dedup_matches_brute_force(spark):
    docs = table(spark)
    texts = {r.doc_id: words(r.text) for r in docs.collect()}
    first = {}
    for i in sorted(texts):
        for s in range(len(texts[i]) - 49):
            first.setdefault(tuple(texts[i][s : s + 50]), i)
    got = by_id(substring_dedup.substring_dedup(docs))
    for i, w in texts.items():
        gone = {p for s in range(len(w) - 49) if first[tuple(w[s : s + 50])] < i for p in range(s, s + 50)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())


def _components(texts):
    sets = {}
    for i, t in texts.items():
        w = words((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[i] = {tuple(w[s : s + 5]) for s in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return {i: (len(s), label[i]) for i, s in sets.items()}


def test_jaccard_components_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = list(TEXTS)
    for copy in range(40):  # chains of near copies and a shared passage
        w = words(BASE)
        for p in rng.integers(0, 70, copy % 7):
            w[p] = f"n{copy}"
        texts.append(" ".join(w[: 40 + copy]) + (" " + " ".join(f"t{copy}x{k}" for k in range(copy % 25))))
    docs = table(spark, texts)
    want = _components({r.doc_id: r.text for r in docs.collect()})
    assert {i: (r.n_shingles, r.component_id) for i, r in by_id(ngram_join.jaccard_components(docs)).items()} == want


def test_ids_shared_by_different_texts(spark):
    other = " ".join(f"v{i}" for i in range(90))
    alone = " ".join(f"u{i}" for i in range(60))
    texts = [(1, BASE), (2, other), (5, "x y " + other), (5, BASE + " tail"), (5, "few words"), (7, "a b c " + alone), (7, BASE + " " + alone), (7, other), (9, alone)]
    docs = spark.createDataFrame([(i, t, "en", "a", None) for i, t in texts], SCHEMA)
    first = {}
    for i, t in texts:
        w = words(t)
        for s in range(len(w) - 49):
            first[tuple(w[s : s + 50])] = min(i, first.get(tuple(w[s : s + 50]), i))
    want = []
    for i, t in texts:
        w = words(t)
        gone = {p for s in range(len(w) - 49) if first[tuple(w[s : s + 50])] < i for p in range(s, s + 50)}
        want.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()))
    assert sorted(map(tuple, substring_dedup.substring_dedup(docs).collect())) == sorted(want)
    labels = _components({row: t for row, (_, t) in enumerate(texts)})
    want = sorted((i, labels[row][0], min(texts[r][0] for r in labels if labels[r][1] == labels[row][1])) for row, (i, _) in enumerate(texts))
    assert sorted(map(tuple, ngram_join.jaccard_components(docs).collect())) == want
    kept = {(r.doc_id, r.text) for r in ngram_join.keep_one_of_each(docs).collect()}
    assert kept == {(1, BASE), (2, other), (5, "few words"), (7, "a b c " + alone), (7, BASE + " " + alone)}


def test_rows_without_an_id_link_by_their_text(spark):
    other = " ".join(f"v{i}" for i in range(90))
    rows = [(1, BASE), (2, other), (None, BASE), (None, "x y " + other), (None, None), (None, BASE + " tail"), (None, " ".join(f"z{i}" for i in range(30))), (4, "")]
    got = collections.Counter(map(tuple, ngram_join.jaccard_components(spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)).collect()))
    assert got == collections.Counter({(1, 66, 1): 1, (2, 86, 2): 1, (None, 66, 1): 1, (None, 88, 2): 1, (None, 0, None): 1, (None, 67, 1): 1, (None, 26, None): 1, (4, 0, 4): 1})


@pytest.mark.parametrize("kind", [np.uint8, np.uint32, None])
def test_buckets_of_all_sizes_give_the_same_pairs(kind):
    import pyarrow as pa

    rng = np.random.default_rng(2)
    n = np.sort(rng.integers(60, 90, 150))
    points = rng.poisson(n[:, None] / ngram_join.GROUPS, (150, ngram_join.GROUPS)).astype(np.uint32)
    t = pa.table({"doc_id": np.arange(150), "comp": np.arange(150) // 2, "n": n, "pos": np.zeros(150, int), "blk": np.zeros(150, int),
                  "lo": np.zeros(150, int), "hi": np.zeros(150, int), "token": np.zeros(150, int), "point": [p.astype(kind or (np.uint8 if i % 3 else np.uint32)).tobytes() for i, p in enumerate(points)]})
    got = {tuple(p) for p in ngram_join.Bucket(t, 75).pairs().tolist()}
    overlap = np.minimum(points[:, None], points[None]).sum(2)
    want = {(i, j) for i in range(150) for j in range(i + 1, 150)
            if i // 2 != j // 2 and 175 * overlap[i, j] >= 75 * (n[i] + n[j]) and 100 * n[i] >= 75 * n[j]}
    assert got == want


def test_merkle_fingerprints(spark):
    docs = table(spark)
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    got = by_id(merkle.edit_trial(docs))
    for a, b in zip(rows, rows[1:] + rows[:1], strict=True):
        t, nxt = a.text or "", b.text or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        r = got[a.doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.fingerprint == got[b.doc_id].fingerprint) == (t == nxt)
    plan = merkle.edit_trial(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    lines = [f"line {i}." for i in range(64)]
    edited = lines[:40] + ["changed."] + lines[41:]
    pair = spark.createDataFrame([("\n".join(lines), "\n".join(edited))], "a string, b string")
    places = merkle.differing_sections(merkle.fingerprint(F.col("a")), merkle.fingerprint(F.col("b")))
    assert pair.select(places).first()[0] == [2]


def test_merkle_ranges_of_skewed_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(merkle, "ROWS_PER_RANGE", 40)
    extra = [(None, f"null {i}.", None, None, None) for i in range(500)]
    extra += [(5_000, f"same id {i}.", None, None, None) for i in range(300)] + [(x, f"far {x}.", None, None, None) for x in (9 * 10**18, -(2**63))]
    docs = table(spark, [f"text {i}." for i in range(1500)], extra)
    rows = docs.select("doc_id", "text")
    firsts = merkle.bounds(rows)
    number, is_first = merkle.range_no(firsts)
    ranges = merkle._keyed(rows).withColumn("range_no", number).groupBy("range_no").agg(F.count("*").alias("n"), F.sum(is_first.cast("int")).alias("first"))
    sizes = {r.range_no: r for r in ranges.collect()}
    assert set(sizes) == set(range(1, len(firsts) + 1))
    assert max(r.n for r in sizes.values()) <= 40 and {r.first for r in sizes.values()} == {1}
    order = [r.text for r in rows.withColumn("h", F.xxhash64("text")).orderBy("doc_id", "h", "text").collect()]
    got = {r.text: r.next_text for r in merkle.with_next(rows, ["text"]).collect()}
    assert len(got) == len(order) and all(got[a] == b for a, b in zip(order, order[1:] + order[:1], strict=True))


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    texts = [*TEXTS, *[f"Some words, number {i}. " * (i % 40 + 1) for i in range(60)], "İ ß Σ 漢 <|endoftext|> it's"]
    docs = table(spark, texts)
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    ids = {r.doc_id: np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4") for r in docs.collect()}
    rows = packing.pack(docs, window=256).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id]) and len(part) == r.length > 0
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for held, whole in [(pieces[i], len(x)) for i, x in ids.items()] + [(s, None) for s in sequences.values()]:
        at = 0
        for start, length in sorted(held):
            assert start == at
            at += length
        assert at == whole if whole else at <= 256 and (at == 256 or at & (at - 1) == 0)


def test_language_and_quality_and_toxicity_hold_out(spark):
    docs, labels = (spark.read.parquet(f"{SMOKE}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
    for score, label in ((quality.score_quality, "quality"), (toxicity.score_toxicity, "toxic")):
        held = score(docs, labels).join(labels, "doc_id").where("held_out")
        assert held.select(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0] > 0.9


def test_quality_fits_on_whole_samples_at_full_width(spark, monkeypatch):
    docs = table(spark, [f"{chr(97 + i % 26)}{i} prose {'end. ' * (i % 9)}" for i in range(2900)])
    labels = spark.createDataFrame([(i * 3, int(i % 5 < 3)) for i in range(2900)], "doc_id long, quality int")
    given = []

    class Seen(quality.Model):
        def __init__(self, positive, unlabelled, prior):
            given.extend((positive, unlabelled))
            super().__init__(positive, unlabelled, prior, rounds=1)

    monkeypatch.setattr(quality, "Model", Seen)
    quality.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    fitted = [i for i in texts if i // 3 % 5 < 3 and zlib.crc32(str(i).encode()) % 5]
    assert 1000 < len(fitted) < 1500
    for x, ids in zip(given, (fitted, texts), strict=True):
        want = {quality.raw_features(texts[i]).tobytes() for i in ids}
        assert len(x) == len(ids) and {row.tobytes() for row in x} == want


def test_classifiers_on_awkward_rows(spark):
    docs = table(spark, extra=[(None, "12 34", None, None, None)])
    found = language.identify(docs).collect()
    assert len(found) == len(TEXTS) + 1 and {r.lang_pred for r in found if r.doc_id in (15, 18, 21, None)} == {"und"}
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score_quality(docs, none).collect()} == {0.5}
    assert {r.score for r in toxicity.score_toxicity(docs, none).collect()} == {0.0}
    labels = spark.createDataFrame([(i * 3, i % 2, i % 2) for i in range(len(TEXTS))], "doc_id long, quality int, toxic int")
    for rows in (quality.score_quality(docs, labels), toxicity.score_toxicity(docs, labels)):
        assert all(0 <= r.score <= 1 for r in rows.collect())


def test_pii_base_spans_match_the_patterns():
    import random

    random.seed(3)
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for _ in range(5000):
        text = "".join(random.choice("a@.@..0123+- (_é\n5") for _ in range(random.randint(0, 40)))
        want = [("email", *m.span()) for m in email.finditer(text)]
        want += [("ip", *m.span()) for m in ip.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
        for kind, pattern, least, most in (("card", r"[0-9]([\x20-]?[0-9])+", 16, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 8, 15)):
            for m in re.finditer(pattern, text):
                digits = re.sub("[^0-9]", "", m[0])
                if least <= len(digits) <= most and (kind == "phone" or pii.luhn(digits)):
                    want.append((kind, *m.span()))
        assert sorted(pii.base_spans(text)) == sorted(want), text


def test_pii_long_runs_in_linear_time():
    import time

    assert pii.base_spans("0" * 5000 + ".1.1.1") == [("ip", 0, 5006)]
    assert pii.base_spans("0" * 5000 + "256.1.1.1") == []
    began = time.monotonic()
    for text in ("a@b" * 300_000, "@" * 900_000, "a" * 1_000_000 + "@", "1." * 500_000, "+1" * 500_000):
        pii.base_spans(text)
    assert pii.emails("x" * 900_000 + "@a.b") == [(0, 900_004)]
    assert time.monotonic() - began < 30


def test_pii_repeated_token_takes_the_label_of_its_twin(spark):
    rows = [f"Write to jo.smith{i}@mail.example.com or +1 212 555 01{i:02d}. Room 7, year 1999." for i in range(60)]
    docs = table(spark, [*rows, "Ask jo.smith9@mail.example.com. Later jo.smith9@mail said no.", None])
    found = by_id(pii.find_pii(docs))
    assert found[180].n_email == 1 and "email:38:52" in found[180].spans
    assert found[183].spans == "" and found[183].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_pii_fits_on_all_tokens_and_every_kind(spark, monkeypatch):
    numbers = " ".join(f"{i} rooms" for i in range(250))
    assert pii.train(table(spark, [numbers + " jo.smith@mail.example.com"])) is not None  # the span is past 200 tokens
    given = []

    class Seen(pii.Field):
        def __init__(self, x, y, *rest):
            given.append(set(y.tolist()))
            super().__init__(x, y, *rest)

    monkeypatch.setattr(pii, "Field", Seen)
    monkeypatch.setattr(pii, "FIT_DOCUMENTS", 10)
    rare = {150: "from 10.20.30.40 today", 450: "from 10.20.30.41 today"}
    pii.train(table(spark, [rare.get(i, f"jo{i}@mail.example.com 12") for i in range(900)]))
    assert given == [{0, 1, 2}]


def test_pii_far_mentions_reach_their_clear_twin():
    n = len(pii.KINDS) + 1
    field = pii.Field.__new__(pii.Field)
    field.shape, field.chain = np.zeros((pii.FEATURES, n)), np.zeros((n, n))
    field.shape[0, 0] = 1.0  # by its shape alone a token is none
    clear, damaged = "jo.smith9@mail.example.com", "jo.smith9@mail"
    for text in (clear + f" and {damaged}" * 40, f"{damaged} and " * 40 + clear, f"{damaged} and " * 20 + clear + f" and {damaged}" * 20):
        assert len(pii.added_spans(text, pii.base_spans(text), field)) == 40
    assert pii.added_spans(damaged * 40, [], field) == []


def planted_mentions(n, seed):
    """Texts with a clear mention and a far damaged one, or a trap; the damaged mentions of each."""
    import random

    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    filler = lambda: " ".join(rng.choice(["room", "2024", "of", "17", "late", "A4", "@home", "12.5"]) for _ in range(rng.randint(5, 60)))

    def checked(good):
        while True:
            x = digits(16)
            if pii.luhn(x) == good:
                return x

    texts, planted = [], []
    for i in range(n):
        kind, gap = pii.KINDS[i % 4], filler()
        name, number, ip, card = f"jo{digits(5)}", "1" + digits(10), [str(rng.randint(10, 255)) for _ in range(4)], checked(True)
        clear, twin = {
            "email": (f"{name}@mail.example.com", rng.choice([f"{name}@mail", f"{name}@mail_example"])),
            "ip": (".".join(ip), rng.choice(["-", "_", ":"]).join(ip)),
            "card": (rng.choice([card, " ".join(card[j : j + 4] for j in range(0, 16, 4))]), rng.choice([".", "/"]).join(card[j : j + 4] for j in range(0, 16, 4))),
            "phone": (f"+{number[0]} {number[1:4]} {number[4:7]} {number[7:]}", rng.choice([number, f"({number[:4]}){number[4:7]}-{number[7:]}"])),
        }[kind]
        trap = rng.choice([checked(False), f"{name}x@mail", "1" + digits(10), "-".join(ip[::-1] + ["7"])])
        parts = [clear, gap, twin] if i % 3 else [clear, gap, trap]  # the trap is like no clear mention
        if i % 2:
            parts = [*parts[::-1]]
        texts.append(f"{filler()} for {parts[0]} was {parts[1]} and {parts[2]} then {filler()}")
        planted.append({(kind, texts[-1].index(f" {twin} ") + 1, texts[-1].index(f" {twin} ") + 1 + len(twin))} if i % 3 else set())
    return texts, planted


def test_pii_added_spans_are_precise_and_whole(spark):
    texts, _ = planted_mentions(400, 1)
    field = pii.train(table(spark, texts))
    off = field.skip - np.diag(np.diag(field.skip))
    assert (np.diag(field.skip)[1:] > off[1:].max(1)).all() and not np.allclose(field.skip, pii.SKIP * np.eye(len(pii.KINDS) + 1))
    texts, planted = planted_mentions(1200, 2)
    right = wanted = given = 0
    for text, want in zip(texts, planted, strict=True):
        got = pii.added_spans(text, pii.base_spans(text), field)
        # the same characters, the marks at their ends aside
        hits = sum(any(k == g[0] and s - 1 <= g[1] <= s + 1 and e - 1 <= g[2] <= e + 1 for k, s, e in want) for g in got)
        right, wanted, given = right + hits, wanted + len(want), given + len(got)
    assert right >= 0.9 * wanted and right >= 0.95 * given, (right, wanted, given)


def test_pii_skip_potential_follows_its_gradient():
    rng = np.random.default_rng(5)
    n, field = len(pii.KINDS) + 1, pii.Field.__new__(pii.Field)
    field.shape = rng.normal(size=(pii.FEATURES, n))
    x, y, other, count = rng.normal(size=(60, pii.FEATURES)), rng.integers(0, n, 60), rng.integers(0, n, 60), rng.integers(1, 9, 60).astype(float)
    skip = field._fit_skip(x, y, other, count, rounds=4000)
    weight = count / np.bincount(other, count, n)[other]

    def loss(w):
        logit = x @ field.shape + w[other]
        return (weight * (np.log(np.exp(logit).sum(1)) - logit[np.arange(60), y])).sum() + 0.5e-3 * (w**2).sum()

    assert np.allclose(skip, skip.T)
    for i in range(n):
        for j in range(i, n):
            step = np.zeros((n, n))
            step[i, j] = step[j, i] = 1e-4
            assert abs(loss(skip + step) - loss(skip - step)) / 2e-4 < 1e-2


def test_pii_failed_checks_stay_out_without_a_twin(spark):
    rows = [f"Card 4111 1111 1111 1111 and card 4012888888881881 seen by jo{i}@mail.example.com." for i in range(60)]
    docs = table(spark, [*rows, "Order 4111111111111112 of 4012888888881882.", "Pay 4111 1111 1111 1111, not 1111 nor 4111111111111112."])
    found = by_id(pii.find_pii(docs))
    assert found[180].spans == "" and found[183].n_added == 0 and found[183].n_card == 1


def test_mixing_meets_targets(spark):
    docs = table(spark, [f"{'word ' * (i % 90)}" if i % 9 else None for i in range(400)])
    rows = mixing.mix_words(docs).collect()
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in rows:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    assert all(r.source_size == size[r.source] for r in rows) and sum(target.values()) == pytest.approx(sum(size.values()))
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 2 for s in target)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix_words(docs).collect()))


def test_mixed_documents_meet_targets_in_whole_rows(spark):
    texts = [f"{'word ' * (i % 90)}" if i % 9 else None for i in range(3000)]
    for i, n in ((4, 9000), (6, 4000), (8, 3000), (0, 70_000)):  # a few long ones hold most of source a; one the null source
        texts[i] = "long " * n
    docs = table(spark, texts, extra=[(None, "no id " * 5, None, "a", None), (3, texts[1], "en", "b", None)])
    docs = docs.withColumns({"turns": F.lit("clash"), "xx": F.lit(1), "size": F.lit(2)})
    target = {r.source: r.target for r in mixing.mix_words(docs).select("source", "target").distinct().collect()}
    for seed in range(3):
        out = mixing.mixed_documents(docs, seed=seed)
        assert out.columns == docs.columns
        got, size = collections.Counter(), {r.doc_id: len(words(r.text)) for r in docs.collect()}
        times = collections.Counter()
        for r in out.collect():
            got[r.source] += len(words(r.text))
            times[r.doc_id] += 1
        longest = {None: 70_000}
        for s in target:
            assert abs(got[s] - target[s]) <= (longest[s] / 2 if s in longest else 91), (seed, s)
        assert all(size[i] > 0 for i in times) and max(times.values()) <= 2 * mixing.REPEAT


def test_targets_and_seats():
    assert mixing.capped_targets([10, 100, 100], [5, 2, 1]) == [30, 120, 60]
    shares = [53_000, 24_000, 23_000]
    seats = [0, 0, 0]
    for _ in range(7):
        seats[max(range(3), key=lambda i: shares[i] / (2 * seats[i] + 1))] += 1
    assert mixing.sainte_lague(shares, 7) == seats
    assert mixing.sainte_lague([1, 1], 5, [1, 9]) == [1, 4]


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    runs = [exact_dedup.exact_groups, exact_dedup.drop_exact_copies, substring_dedup.substring_dedup, ngram_join.jaccard_components,
            ngram_join.keep_one_of_each, merkle.edit_trial, packing.pack, language.identify, language.keep_identified, pii.find_pii,
            mixing.mix_words, mixing.mixed_documents, lambda d: quality.score_quality(d, labels), lambda d: toxicity.score_toxicity(d, labels)]
    for run in runs:
        assert run(docs).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_twins(spark, name):
    con = duckdb.connect()
    for given in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {given} AS SELECT * FROM '{SMOKE}/{given}.parquet'")
    want = con.execute(queries.SQL[name]).df()
    got = queries.QUERIES[name](spark, SMOKE).toPandas()[list(want.columns)]
    want, got = (x.sort_values(want.columns[0]).reset_index(drop=True).astype(str) for x in (want, got))
    assert want.equals(got)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SMOKE)
        assert kept.columns == docs.columns, name
    rows = corpus_pipeline.run(spark, SMOKE)
    assert rows.count() > 0 and rows.select("doc_id").distinct().count() <= docs.count()


def test_every_operator_with_clashing_columns(spark):
    docs = table(spark, [*TEXTS, *[f"Mail jo{i}@mail.example.com, 10.0.0.{i}." for i in range(9)]])
    labels = spark.createDataFrame([(i * 3, i % 2, i % 2) for i in range(len(TEXTS))], "doc_id long, quality int, toxic int")
    names = """kept keep_id xx row row_no id hash s1 s2 n n_words n_removed starts first_id comp component_id kind x y mark shard size stop turns taken
               target source_size weight range_no at next_text fingerprint score held_out predicted lang_pred label a b h k s t d gone words token point
               rare salt piece_id start length offset sequence_id quality toxic passes left""".split()
    extra = {c: F.lit("clash") for c in names}
    wide, wide_labels = docs.withColumns(extra), labels.withColumns({c: x for c, x in extra.items() if c not in ("quality", "toxic")})
    scores = [(quality.score_quality, "score"), (toxicity.score_toxicity, "score")]
    runs = [exact_dedup.exact_groups, substring_dedup.substring_dedup, substring_dedup.removed_text, ngram_join.jaccard_components, merkle.edit_trial,
            merkle.fingerprints, language.identify, pii.find_pii, mixing.mix_words, mixing.whole_turns] + [lambda d, f=f: f(d, wide_labels) for f, _ in scores]
    for run in runs:
        want, got = run(docs), run(wide)
        assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    packed = [collections.Counter((r.doc_id, r.doc_tokens) for r in packing.pack(d).where("start = 0").collect()) for d in (docs, wide)]
    assert packed[0] == packed[1]
    for run in (exact_dedup.drop_exact_copies, ngram_join.keep_one_of_each, language.keep_identified, mixing.mixed_documents):
        got = run(wide)
        assert got.columns == wide.columns
        assert {r.xx for r in got.collect()} == {"clash"}
        assert sorted(map(repr, got.select(docs.columns).collect())) == sorted(map(repr, run(docs).collect()))


def _plain_near(rows):
    sets, held, label = {}, collections.defaultdict(list), {}
    for r in rows:
        w = words((r.text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[r.doc_id] = {tuple(w[s : s + 5]) for s in range(max(1, len(w) - 4))} if w else set()
        label[r.doc_id] = r.doc_id
        for shingle in sets[r.doc_id]:
            held[shingle].append(r.doc_id)
    pairs = {(a, b) for ids in held.values() for a in ids for b in ids if a < b}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in sets:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            return label


def _seats(shares, seats, most):
    """Highest quotients, one seat after the other."""
    won = [0] * len(shares)
    for _ in range(min(seats, sum(m for m, s in zip(most, shares, strict=True) if s))):
        won[max((i for i in range(len(won)) if won[i] < most[i]), key=lambda i: shares[i] / (2 * won[i] + 1))] += 1
    return won


def _plain_mix(rows, marks):
    """doc_id -> turns, of rows with different ids; blocks of such small tables are single words."""
    size = {r.doc_id: len(words(r.text)) for r in rows}
    order = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    own = {s: [r.doc_id for r in rows if r.source == s and size[r.doc_id]] for s in order}
    held = {s: sum(size[i] for i in own[s]) for s in order}
    total = sum(held.values())
    targets = mixing.capped_targets([held[s] for s in order], [mixing.WEIGHTS[k % 3] for k in range(len(order))])
    turns = {}
    for s, quota in zip(order, _seats(targets, total, [total] * len(order)), strict=True):
        passes, rest = divmod(min(quota, 3 * held[s]), held[s])
        large = sorted((i for i in own[s] if size[i] * 1000 > held[s]), key=marks.get)
        share, taken = rest * sum(size[i] for i in large) / held[s], 0
        for i in large:
            turns[i] = passes + (taken + size[i] / 2 <= share)
            taken += size[i] * (turns[i] - passes)
        shards = collections.defaultdict(list)
        for i in sorted(set(own[s]) - set(large), key=marks.get):
            shards[marks[i] % 16].append(i)
        shards = [shards[k] for k in sorted(shards)]
        holds = [sum(size[i] for i in ids) for ids in shards]
        missing = rest - taken  # what the source still lacks after each shard took what its quota holds
        fills = _seats(holds, max(0, missing), holds)
        missing -= sum(fills)
        for ids, fill in zip(shards, fills, strict=True):
            crossed = False
            for i in ids:
                inside = size[i] <= fill and not crossed
                if inside:
                    fill -= size[i]
                elif not crossed:
                    crossed, missing = True, missing + fill
                    inside = size[i] / 2 <= missing
                    missing -= size[i] * inside
                turns[i] = passes + inside
    return turns


def test_pipeline_matches_plain_python(spark, tmp_path):
    import unicodedata

    import corpus_pipeline
    from tokenizers import Tokenizer

    texts = [*TEXTS, "12 34.", *[BASE + f" tail{i}" for i in range(5)], *[" ".join(f"long{i}x{k}" for k in range(900 + i)) for i in range(9)]]
    texts += [f"one{i}" + " more" * (i % 3) for i in range(1100)] + [f"one{i}" + " more" * (i % 3) + "\n" for i in range(0, 1100, 50)]
    docs = table(spark, texts).orderBy("doc_id")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows, stages = docs.collect(), iter(corpus_pipeline.STAGES)

    def after(kept):
        """The next stage's rows, which are the rows of ``kept`` as often as it says."""
        name, stage = next(stages)
        got = stage(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect()
        want = collections.Counter({tuple(r): kept[r.doc_id] for r in rows if kept.get(r.doc_id)})
        assert collections.Counter(map(tuple, got)) == want, name
        return got

    rows = after({r.doc_id: int(any(unicodedata.category(c)[0] == "L" for c in r.text or "")) for r in rows})
    first = {re.sub(r"[\x20\x09-\x0D]+", " ", r.text): r.doc_id for r in sorted(rows, key=lambda r: -r.doc_id)}
    rows = after({i: 1 for i in first.values()})
    label = _plain_near(rows)
    assert 1 < sum(i != c for i, c in label.items()) < len(label)
    rows = after({i: int(i == c) for i, c in label.items()})
    marks = spark.createDataFrame(rows, SCHEMA).withColumn("xx", F.xxhash64("text")).select("doc_id", F.xxhash64("doc_id", "xx", F.lit(0)).alias("m"))
    turns = _plain_mix(rows, {r.doc_id: r.m for r in marks.collect()})
    assert {0, 1} < set(turns.values())
    rows = after(turns)

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    ids = {r.doc_id: np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 2], "<u4") for r in rows}
    for pieces in (corpus_pipeline.STAGES[-1][1](spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)), corpus_pipeline.run(spark, str(tmp_path))):
        seen, sequences = {i: np.zeros(len(x), int) for i, x in ids.items()}, collections.defaultdict(list)
        for r in pieces.collect():
            part = ids[r.doc_id][r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(part.tobytes()) and len(part) == r.length
            seen[r.doc_id][r.start : r.start + r.length] += 1
            sequences[r.sequence_id].append((r.offset, r.length))
        assert all((seen[i] == turns[i]).all() for i in ids)
        for held in sequences.values():
            at = 0
            for offset, length in sorted(held):
                assert offset == at
                at += length
            assert at <= packing.WINDOW


def test_word_hashes_tell_words_apart():
    rng = random.Random(5)
    words = [bytes(rng.choices(b"ab\xc3\xa9.", k=rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 24, 63, 64, 65, 200]))) for _ in range(4000)]
    found = common.word_hashes(b"  " + b" ".join(words) + b" ").tolist()
    assert len(found) == len(words) and len(set(zip(words, found, strict=True))) == len(set(words)) == len(set(found))
    assert [common.word_hashes(w).tolist() for w in words[:200]] == [[h] for h in found[:200]]
    assert all(len(common.word_hashes(x)) == 0 for x in (b"", b" ", b"   "))


def test_shingles_are_those_of_the_split_words():
    shingles = ngram_join.Shingles(5)
    for text in [b"", b" \t", b"One two", b"a b\tc\x0bd\x0ce\r\nF g a B c d e", "Ä ä\u00a0x y\u2003z É é é é é é".encode(), b"same " * 50]:
        words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in text.split()]
        want = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        got = shingles.of(text)
        assert len(got) == len(want) and (np.diff(got.astype(object)) > 0).all()
        assert shingles.of(b"  " + b"\n".join(words)).tolist() == got.tolist()


def test_shingling_holds_no_words():
    """A worker keeps nothing a word: its memory does not grow with the vocabulary."""
    shingles = ngram_join.Shingles(5)
    shingles.of(b"warm up " * 500)
    tracemalloc.start()
    for i in range(60):
        shingles.of(" ".join(f"word{i}x{j}" for j in range(1000)).encode())
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 1_000_000


def test_tasks_of_the_pipeline_give_freed_memory_back(monkeypatch):
    freed = []
    monkeypatch.setattr(common, "free_memory", lambda: freed.append(1))
    bits = np.zeros(1, np.uint8)
    tasks = [
        language._features, language._predict(None), language._known(None), exact_dedup._fingerprints(exact_dedup.MODULI),
        ngram_join._survey(5), ngram_join._prefixes(5, 75, bits), ngram_join._mixed_tokens(bits, 7), ngram_join._bucket_pairs(75),
        ngram_join._sets(5, bits, 7), ngram_join._alike(75), common._texts(bits, 7),
        packing._pieces(packing.tokenizer_path(), 4096, 2), packing._recut(packing.tokenizer_path(), 2),
    ]
    for n, task in enumerate(tasks):
        list(task(iter([])))
        assert len(freed) == n + 1


def test_packing_tasks_of_a_worker_share_the_tokenizer_and_no_words(monkeypatch, tmp_path):
    made = []

    class Counted(packing.Ids):
        def __init__(self, path):
            made.append(self)
            super().__init__(path)

    monkeypatch.setattr(packing, "Ids", Counted)
    path = shutil.copy(packing.tokenizer_path(), tmp_path)  # a path that no worker has loaded
    cuts = pa.array([[{"piece_id": 5, "start": 0, "length": 2}]])
    for text in ("the word is", "the word is", "another word"):
        batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1], pa.int64()), "hash": pa.array([7], pa.int64()), "text": [text], "cuts": cuts})
        pieces = next(packing._pieces(path, 2, 2)(iter([batch])))
        assert [b.num_rows for b in packing._pieces(path, 2, 2)(iter([batch]))] == [pieces.num_rows]
        assert [b.column("crc").to_pylist() for b in packing._recut(path, 2)(iter([batch]))] == [pieces.column("ids_crc32").to_pylist()[:1]]
    assert len(made) == 1 and not made[0]
