"""Document fingerprints: a Merkle tree over the paragraphs and sections of a text.

Leaves are sentences (or stretches of at most LEAF_CHARS characters without
a sentence end), paragraphs are lines, sections are runs of SECTION lines.
A leaf is the SHA-256 of its text, a paragraph that of its leaves' hashes, and
so on up to the root, which is also bound to the number of characters.
Everything is a built-in SQL function, so no row leaves the JVM.

The fingerprint is text: ``root|section:paragraph,paragraph;section:...``, a
section as 16 hex digits, a paragraph as its leaves, 8 hex digits each.
Equal texts have equal roots; below different roots ``differing_sections``
names the branches that differ.

Defined cases: null text counts as empty; an empty text has one paragraph
without leaves; likeness of two texts without leaves is 1; rows with a null
``doc_id`` come before all others in document order, rows with equal ids are
ordered by a hash of their text, then by their text; a table of one row is its own next document; an empty
table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from staylens.llm.common import id_and_text
from staylens.session import cut_lineage

SECTION = 16
LEAF_CHARS = 48
ROWS_PER_RANGE = 512  # documents of one window partition in tables of up to 33 million
MAX_RANGES = 1 << 16  # the bound of what reaches the driver and stands in the plan
_LEAF = f"[^.!?\\n]{{1,{LEAF_CHARS}}}[.!?]*|[.!?]+"


def _sha(x: Column) -> Column:
    return F.sha2(x, 256)


def tree(text: Column) -> Column:
    """array<section: array<paragraph: array<leaf hash>>>"""
    lines = F.transform(
        F.split(text, "\n", -1), lambda line: F.transform(F.regexp_extract_all(line, F.lit(_LEAF), F.lit(0)), lambda leaf: F.substring(_sha(leaf), 1, 32))
    )
    starts = F.sequence(F.lit(1), F.size(lines), F.lit(SECTION))
    return F.transform(starts, lambda i: F.slice(lines, i, SECTION))


def fingerprint(text: Column) -> Column:
    """The Merkle fingerprint of a non-null text column."""
    sections = F.transform(
        tree(text),
        lambda section: F.concat(
            F.substring(_sha(F.concat_ws("", F.transform(section, lambda p: _sha(F.concat_ws("", p))))), 1, 16),
            F.lit(":"),
            F.concat_ws(",", F.transform(section, lambda p: F.concat_ws("", F.transform(p, lambda leaf: F.substring(leaf, 1, 8))))),
        ),
    )
    body = F.concat_ws(";", sections)
    return F.concat(_sha(F.concat_ws("|", F.length(text).cast("string"), body)), F.lit("|"), body)


def root(mark: Column) -> Column:
    return F.substring_index(mark, "|", 1)


def leaves(mark: Column) -> Column:
    """The leaf hashes of a fingerprint, without section hashes."""
    body = F.substring_index(mark, "|", -1)
    return F.regexp_extract_all(F.regexp_replace(body, "(^|;)[0-9a-f]{16}:", ""), F.lit("[0-9a-f]{8}"), F.lit(0))


def likeness(mark: Column, other: Column) -> Column:
    """Twice the common leaves over all leaves (distinct ones), 1 if the roots agree."""
    a, b = F.array_distinct(leaves(mark)), F.array_distinct(leaves(other))
    total = F.size(a) + F.size(b)
    common = F.size(F.array_intersect(a, b))
    return F.when(root(mark) == root(other), F.lit(1.0)).when(total == 0, F.lit(1.0)).otherwise(2.0 * common / total)


def differing_sections(mark: Column, other: Column) -> Column:
    """Numbers (from 0) of the sections whose branches differ, an edit's place; sections past the shorter text count."""
    a, b = (F.split(F.substring_index(x, "|", -1), ";", -1) for x in (mark, other))
    places = F.sequence(F.lit(0), F.greatest(F.size(a), F.size(b)) - 1)
    return F.when(root(mark) == root(other), F.array().cast("array<int>")).otherwise(
        F.filter(places, lambda i: ~F.get(a, i).eqNullSafe(F.get(b, i)))
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of every document."""
    text = F.coalesce("text", F.lit(""))
    return id_and_text(docs).select("doc_id", F.length(text).cast("long").alias("n_chars"), fingerprint(text).alias("fingerprint"))


def _keyed(rows: DataFrame) -> DataFrame:
    """With the order of documents as two columns without nulls: null ids first, equal ids by a hash of the text."""
    before_all = F.lit("-9223372036854775809").cast("decimal(20,0)")
    return rows.withColumns({"key_id": F.coalesce(F.col("doc_id").cast("decimal(20,0)"), before_all), "key_hash": F.xxhash64("text")})


def bounds(rows: DataFrame) -> list[tuple[str, int]]:
    """The first key of each range: every ROWS_PER_RANGE-th key of ranges that Spark samples from the keys."""
    keys = cut_lineage(_keyed(rows).select("key_id", "key_hash"), "op4-keys")
    step = max(ROWS_PER_RANGE, -(-keys.count() // MAX_RANGES))
    order = keys.repartitionByRange("key_id", "key_hash").sortWithinPartitions("key_id", "key_hash")
    order = order.withColumn("k", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))  # the row's place in its partition
    found = order.where(F.col("k") % step == 0).select("key_id", "key_hash").collect()  # MAX_RANGES, and one a partition, at most
    return [(str(i), h) for i, h in sorted({(r.key_id, r.key_hash) for r in found})]


def range_no(firsts: list[tuple[str, int]]) -> tuple[Column, Column]:
    """The number (from 1) of a keyed row's range, by bisection, and whether the row has the first key of its range."""
    ids, hashes = (F.split(F.lit(",".join(str(f[k]) for f in firsts)), ",").cast(f"array<{kind}>") for k, kind in ((0, "decimal(20,0)"), (1, "bigint")))
    steps = [1 << k for k in reversed(range(len(firsts).bit_length()))]

    def nearer(at: Column, step: Column) -> Column:
        first_id, first_hash = F.get(ids, at + step - 1), F.get(hashes, at + step - 1)
        passed = (first_id < F.col("key_id")) | ((first_id == F.col("key_id")) & (first_hash <= F.col("key_hash")))
        return F.when(passed, at + step).otherwise(at)

    number = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), nearer)
    return number, (F.get(ids, F.col("range_no") - 1) == F.col("key_id")) & (F.get(hashes, F.col("range_no") - 1) == F.col("key_hash"))


def with_next(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Each row with ``columns`` of the row after it in document order (after the last: the first) as next_<column>.

    Rows are dealt to ranges of keys taken from the keys themselves, so that a
    range has ROWS_PER_RANGE rows or little more, however the ids lie.  The first row of
    each range also visits the range before it, so one window per range sees
    every successor and each text is shuffled once.  Only rows equal in id and text
    cannot be parted.
    """
    names, firsts = rows.columns, bounds(rows)
    if not firsts:
        return rows.select(*names, *(F.col(c).alias(f"next_{c}") for c in columns))
    number, is_first = range_no(firsts)
    before = F.when(F.col("range_no") == 1, F.lit(len(firsts))).otherwise(F.col("range_no") - 1)
    home = F.struct(F.col("range_no"), F.lit(False).alias("guest"))
    away = F.struct(F.when(is_first, before).alias("range_no"), F.lit(True).alias("guest"))
    placed = _keyed(rows).withColumn("range_no", number).select(
        *names, "key_hash", F.explode(F.filter(F.array(home, away), lambda x: x["range_no"].isNotNull())).alias("at")
    )
    near = Window.partitionBy("at.range_no").orderBy("at.guest", "doc_id", "key_hash", "text")
    after = [F.lead(c).over(near).alias(f"next_{c}") for c in columns]
    return placed.select(*names, "at", *after).where("NOT at.guest").drop("at")


def edit_trial(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose second half is the start of the next document."""
    rows = id_and_text(docs).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("fingerprint", fingerprint(F.col("text")))
    rows = with_next(rows, ["text", "fingerprint"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    rows = rows.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return rows.select(
        "doc_id", "n_chars", _sha("edited").alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
