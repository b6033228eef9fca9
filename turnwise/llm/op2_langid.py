"""Language ID by rank-order profiles.

A profile is the list of a language's most frequent n-grams (1 to 3 characters of
lower-cased words, padded with a blank on each side). A document's own list is held
against each profile: every n-gram adds how far its rank is out of place, and the
profile's length where the profile lacks it. The nearest profile names the language.

Profiles are fitted on about ``per_lang`` documents of each language, those with a
small hash of their id: a bound that keeps the fit small at any scale. Every whole
text is scored.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
without any training row every text is ``und``; equal counts rank by the n-gram's
code, equal distances go to the first language by name; repeated rows count again;
rows without doc_id are held out; a very long text is ranked whole; an empty table
gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnwise.llm.common import bounded_sample, held_out, slices

PROFILE = 400
PER_LANG = 2000
_LETTER: dict = {}
_SHIFT = np.int64(21)


def _letters() -> np.ndarray:
    if "t" not in _LETTER:
        _LETTER["t"] = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _LETTER["t"]


def grams(text: str | None) -> np.ndarray:
    """Codes of all 1- to 3-grams: up to three code points of 21 bits, blanks as 32."""
    if not text:
        return np.empty(0, np.int64)
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    ok = _letters()[c]
    if not ok.any():
        return np.empty(0, np.int64)
    c = np.where(ok, c, 32)
    keep = ok.copy()
    keep[:-1] |= ok[1:]  # one blank before each word
    c = np.concatenate((c[keep] if keep[0] and not ok[0] else np.concatenate(([32], c[keep])), [32]))
    one, two = c[c != 32], (c[:-1] << _SHIFT) | c[1:]
    three = (two[:-1] << _SHIFT) | c[2:]
    return np.concatenate((one, two[two != ((32 << 21) | 32)], three[c[1:-1] != 32]))


def ranked(text: str | None, k: int) -> np.ndarray:
    """The text's k most frequent n-grams, most frequent first, ties by code."""
    g = grams(text)
    if not len(g):
        return g
    g.sort()
    at = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    n = np.diff(np.append(at, len(g)))
    if len(at) > 4 * k:  # only counts that can be among the k first are sorted
        floor = np.partition(n, len(n) - k)[len(n) - k]
        at, n = at[n >= floor], n[n >= floor]
    return g[at[np.argsort(-n, kind="stable")[:k]]]


def fit_profiles(labelled: DataFrame, k: int = PROFILE, per_lang: int = PER_LANG) -> dict[str, list[int]]:
    """Profiles from rows (doc_id, text, lang); k codes of each language reach the driver."""
    sample = bounded_sample(labelled.select("doc_id", "text", "lang"), "doc_id", per_lang, "lang", "profile")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                codes, n = np.unique(grams(text), return_counts=True)
                own = seen.setdefault(lang, Counter())
                for c, x in zip(codes.tolist(), n.tolist(), strict=True):
                    own[c] += x
        for lang, own in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own.keys(), pa.int64()), pa.array(own.values(), pa.int64())], names=["lang", "code", "n"])

    counts = sample.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    rows = counts.where("lang is not null").withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("lang", "code", "rank").collect()
    out: dict[str, list[int]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(r["lang"], []).append(r["code"])
    return out


class Profiles:
    """All profiles as one sorted table of codes with a rank column for each language."""

    def __init__(self, profiles: dict[str, list[int]], k: int = PROFILE) -> None:
        self.langs, self.k = sorted(profiles), k
        self.codes = np.unique(np.array([c for p in profiles.values() for c in p], np.int64))
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int64)  # the last row: in no profile
        for j, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.codes, profiles[lang]), j] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        g = ranked(text, self.k)
        if not len(g) or not self.langs:
            return "und", 0.0
        at = np.searchsorted(self.codes, g)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != g)] = len(self.codes)
        r = self.ranks[at]
        far = np.where(r < 0, self.k, np.abs(r - np.arange(len(g))[:, None])).sum(axis=0)
        best = int(far.argmin())
        return self.langs[best], float(1 - far[best] / (self.k * len(g)))


def identify(docs: DataFrame, profiles: dict[str, list[int]], k: int = PROFILE) -> DataFrame:
    """doc_id, lang_pred, score of every whole text."""
    model = Profiles(profiles, k)  # a few thousand numbers, sent with the task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                got = [model.predict(t) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame, folds: int = 5) -> DataFrame:
    """Fit on the documents outside fold 0 and predict all: doc_id, held_out, lang_pred, score."""
    rows = docs.select("doc_id", "text", "lang")
    profiles = fit_profiles(rows.where(~held_out(F.col("doc_id"), folds)))
    out = identify(rows, profiles)
    return out.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "lang_pred", "score")
