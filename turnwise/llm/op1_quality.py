"""Quality rules: learned decision lists, in DataFrame functions only.

Statistics of each text are plain columns. Sequential covering learns an ordered
list of rules from labelled statistics: a rule grows threshold by threshold while
that gains information about low quality, is pruned on rows that didn't grow it,
and takes the rows that it covers out of the sample. The list is emitted as one
Spark conditional expression.

The list is learned from about ``SAMPLE`` labelled documents (all, if fewer), chosen
by the hash of their id: the statistics of a bounded sample reach the driver. All
documents are judged.

Defined results: a null text is an empty one: no words, base_failed; a sample
without both labels gives an empty list, which keeps what the base keeps; equal
gains go to the first statistic, direction and threshold; repeated rows are judged
alike; a row without doc_id is judged like others and never learned from; a label id
that stands twice counts twice; a very long text is one row of arrays as long as its
words; an empty table gives no rows; other columns come through ``kept`` unchanged.
"""

from __future__ import annotations

import math
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import SEPARATORS, bounded_sample

SAMPLE = 8_000
THRESHOLDS = 24
MAX_RULES = 12
MAX_TERMS = 4
#: Share of low quality among the pruning rows that a rule covers, at least.
PRECISION = 0.9
NEAR = 8
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _let(value: Column, f) -> Column:
    """``f(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _count_of(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def repeated_words(words: Column, near: int = NEAR) -> Column:
    """Words in windows of ``near`` words (a power of two) that stand twice or more in the array."""

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        none = F.array().cast("array<int>")
        both = lambda s: F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(none))
        places = _let(ordered, lambda s: F.sort_array(F.array_distinct(F.flatten(both(s)))))
        gaps = _let(places, lambda p: F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.lit(near), F.coalesce(b - a, F.lit(near)))))
        return F.aggregate(gaps, F.lit(0), lambda n, x: n + x)

    def paired(k: int):
        """Hashes of runs of 2k words from those of k words."""
        return lambda a: F.zip_with(F.slice(a, 1, F.size(a) - k), F.slice(a, k + 1, F.size(a) - k), lambda p, q: F.xxhash64(p, q))

    windows, k = words, 1
    while k < near:
        windows, k = _let(windows, paired(k)), 2 * k
    found = _let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))
    return F.when(F.size(words) > near, found).otherwise(F.lit(0)).cast("long")


def statistics(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id (or the whole row, as struct ``doc``) and the statistics of each whole text."""
    key = "doc" if carry else "doc_id"
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc") if carry else F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    text = F.col("text")
    trimmed = F.btrim(text, F.lit(SEPARATORS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SEPARATORS)) != "")
    of_words = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    of_lines = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return rows.select(
        key,
        of_words.alias("w"),
        of_lines.alias("l"),
        (F.length(text) - _count_of(text, SEPARATORS)).cast("long").alias("word_chars"),
        _count_of(text, SYMBOLS).alias("n_symbols"),
        _count_of(text, UPPER).alias("n_upper"),
        _count_of(text, "!?").alias("n_marks"),
    ).select(key, "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines", "n_upper", "n_marks")


#: Interpretable ratios that rules speak of, by name.
FEATURES: dict[str, tuple[str, str]] = {
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_char": ("n_symbols", "word_chars"),
    "upper_per_char": ("n_upper", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
    "dup_lines_per_line": ("n_dup_lines", "n_lines"),
    "repeats_per_word": ("n_repeat_words", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}


def features(stats: DataFrame) -> DataFrame:
    return stats.select("*", *((F.col(a) / F.greatest(F.col(b), F.lit(1))).alias(k) for k, (a, b) in FEATURES.items()))


Term = tuple[str, bool, float]  # feature, at least (or at most), threshold


def learn(rows: list[tuple], names: list[str], max_rules: int = MAX_RULES, precision: float = PRECISION) -> list[list[Term]]:
    """Rules for label 0 from rows (key, label, features...).

    Sets of rows are bit masks, so a condition costs one AND and one count.
    """
    rows = sorted(rows, key=lambda r: r[0])
    if not rows:
        return []
    mask = lambda bits: int("".join("1" if b else "0" for b in bits), 2)
    bad = mask(r[1] == 0 for r in rows)
    grow = mask(zlib.crc32(f"grow{r[0]}".encode()) % 3 for r in rows)
    every = mask(True for _ in rows)
    tests: list[tuple[Term, int]] = []
    for j, name in enumerate(names):
        values = sorted({r[2 + j] for r in rows})
        ordered = sorted(r[2 + j] for r in rows)
        cuts = sorted({values[k * (len(values) - 1) // THRESHOLDS] for k in range(THRESHOLDS + 1)} | {ordered[k * (len(ordered) - 1) // THRESHOLDS] for k in range(THRESHOLDS + 1)})
        for a, b in zip(cuts, cuts[1:], strict=False):
            t = (a + b) / 2
            up = mask(r[2 + j] >= t for r in rows)
            tests += [((name, True, t), up), ((name, False, t), every ^ up)]
    left, out = every, []
    for _ in range(max_rules):
        have, terms = left & grow, []
        while len(terms) < MAX_TERMS and have & ~bad:
            p, n = (have & bad).bit_count(), (have & ~bad).bit_count()
            if not p:
                break
            base, best = math.log2(p / (p + n)), (1e-9, None, 0)
            for term, m in tests:
                if p1 := (have & m & bad).bit_count():
                    gain = p1 * (math.log2(p1 / (have & m).bit_count()) - base)
                    if gain > best[0]:
                        best = (gain, term, m)
            if best[1] is None:
                break
            terms.append((best[1], best[2]))
            have &= best[2]
        worth = lambda ts, rows_=left & ~grow: (lambda c: ((c & bad).bit_count() - (c & ~bad).bit_count()) / max(1, c.bit_count()))(_all(ts, rows_))
        while len(terms) > 1 and worth(terms[:-1]) >= worth(terms):
            terms.pop()
        covered = _all(terms, left) if terms else 0
        held = covered & ~grow
        if not terms or not held & bad or (held & bad).bit_count() < precision * held.bit_count() or (covered & bad).bit_count() < precision * covered.bit_count():
            break
        out.append([t for t, _ in terms])
        left &= ~covered
        if not left & bad:
            break
    return out


def _all(terms: list[tuple[Term, int]], rows: int) -> int:
    for _, m in terms:
        rows &= m
    return rows


def verdict(rules: list[list[Term]]) -> Column:
    """True (keep) or false, the first rule that fits deciding."""
    out = None
    for terms in rules:
        fits = F.lit(True)
        for name, at_least, t in terms:
            fits = fits & (F.col(name) >= F.lit(t) if at_least else F.col(name) <= F.lit(t))
        out = F.when(fits, F.lit(False)) if out is None else out.when(fits, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[list[Term]]:
    """A decision list for labels.quality = 0 from a bounded sample of labelled rows."""
    some = bounded_sample(labels.where("quality is not null and doc_id is not null").select("doc_id", "quality"), "doc_id", sample, salt="quality")
    known = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # about ``sample`` rows of two numbers
    rows = features(statistics(known, carry=True)).select("doc.doc_id", "doc.quality", *FEATURES).collect()
    return learn([tuple(r) for r in rows], list(FEATURES))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def kept(docs: DataFrame, rules: list[list[Term]]) -> DataFrame:
    """The rows, with all their columns, that the base and the rules keep."""
    return features(statistics(docs, carry=True)).where(~base_failed() & verdict(rules)).select("doc.*")


def judge(docs: DataFrame, rules: list[list[Term]]) -> DataFrame:
    """Statistics, base_failed, kept of every document."""
    failed = base_failed()
    return features(statistics(docs)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))
