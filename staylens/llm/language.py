"""Language ID in two levels: the family first, then the languages within it.

One-versus-rest linear support vector machines on hashed letter n-grams choose
the family; inside a family with several languages, one machine for every two
of them votes, ties going to the larger sum of margins.  Both are fitted on at
most about PER_LANGUAGE documents of each language (a documented sample);
every document is scored on its whole text.

Defined cases: null text and text without a letter give ``und`` with score 0;
languages outside FAMILIES are families of their own; a single learned
language is always predicted; without any label every text is ``und``; null
ids and repeated rows are scored like others; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from staylens.llm.common import crc_bucket, frees_memory, id_and_text, sample, small_batches
from staylens.llm.features import DIMS, letter_features, linear_svm, sigmoid

PER_LANGUAGE = 400
HELD_OUT = (4, 2)  # crc32 modulo, remainder
UNKNOWN = "und"
FAMILIES = {
    **dict.fromkeys(["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"], "germanic"),
    **dict.fromkeys(["fr", "es", "it", "pt", "ro", "ca", "gl", "oc"], "romance"),
    **dict.fromkeys(["ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"], "slavic"),
    **dict.fromkeys(["fi", "et", "hu"], "uralic"),
    **dict.fromkeys(["tr", "az", "kk", "uz"], "turkic"),
    **dict.fromkeys(["hi", "mr", "ne", "bn", "gu", "pa", "ur"], "indic"),
    **dict.fromkeys(["ar", "he", "am"], "semitic"),
}


class Model:
    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        labels = np.array(langs, object)
        self.family_of = {lang: FAMILIES.get(lang, lang) for lang in self.langs}
        self.families = sorted(set(self.family_of.values()))
        group = np.array([self.family_of[lang] for lang in langs], object)
        self.top = np.array([linear_svm(x, np.where(group == f, 1.0, -1.0)) for f in self.families]) if len(self.families) > 1 else None
        self.pairs = {}
        for family in self.families:
            for a, b in combinations([g for g in self.langs if self.family_of[g] == family], 2):
                rows = (labels == a) | (labels == b)
                self.pairs[a, b] = linear_svm(x[rows], np.where(labels[rows] == a, 1.0, -1.0))

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        x = np.append(x, 1.0)
        if self.top is None:
            family, sure = self.families[0], 1.0
        else:
            margin = self.top @ x
            odds = np.exp(4 * (margin - margin.max()))
            best = int(margin.argmax())
            family, sure = self.families[best], float(odds[best] / odds.sum())
        langs = [g for g in self.langs if self.family_of[g] == family]
        if len(langs) == 1:
            return langs[0], sure
        votes, sums = dict.fromkeys(langs, 0.0), dict.fromkeys(langs, 0.0)
        for a, b in combinations(langs, 2):
            margin = float(self.pairs[a, b] @ x)
            votes[a if margin >= 0 else b] += 1
            sums[a] += margin
            sums[b] -= margin
        lang = max(langs, key=lambda g: (votes[g], sums[g]))
        return lang, sure * float(sigmoid(4 * sums[lang] / (len(langs) - 1)))


@frees_memory
def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(lang, letter_features(t)) for t, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True)]
        found = [(lang, x.tobytes()) for lang, x in found if x is not None]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.binary())], names=["lang", "x"])


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Fits on a sample of the labelled rows that are not held out."""
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    rows = sample(rows.where(crc_bucket(HELD_OUT[0]) != HELD_OUT[1]), "lang", per_language)
    found = rows.select("text", "lang").mapInArrow(_features, "lang string, x binary").collect()  # bounded by the sample
    if not found:
        return None
    found.sort(key=lambda r: (r.lang, bytes(r.x)))
    return Model(np.frombuffer(b"".join(bytes(r.x) for r in found), np.float32).reshape(-1, DIMS), [r.lang for r in found])


def _predict(model: Model | None):
    @frees_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for text in batch.column("text").to_pylist():
                x = letter_features(text) if text and model else None
                lang, score = model.predict(x) if x is not None else (UNKNOWN, 0.0)
                langs.append(lang)
                scores.append(min(1.0, max(0.0, score)))
            rest = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*rest, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    rows = id_and_text(docs).mapInArrow(_predict(model or train(docs)), "doc_id long, lang_pred string, score double")
    return rows.select("doc_id", (crc_bucket(HELD_OUT[0]) == HELD_OUT[1]).alias("held_out"), "lang_pred", "score")


def _known(model: Model | None):
    @frees_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for row, text in enumerate(batch.column("text").to_pylist()):
                x = letter_features(text) if text and model else None
                if x is not None and model.predict(x)[0] != UNKNOWN:
                    kept.append(row)
            yield batch.take(pa.array(kept, pa.int64()))

    return run


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows whose language is told, with all their columns; texts without a letter go."""
    small_batches(docs.sparkSession)
    return docs.mapInArrow(_known(train(docs)), docs.schema)
