"""Substring dedup with suffix automata of reference shards.

A suffix automaton over words holds every run of words of a shard of reference
text with its number of occurrences. Documents are streamed through it: at each
word the automaton keeps the longest run that ends there and occurs in the shard
(matching statistics); where that run is as long as the threshold and occurs often
enough, the words that it covers are part of a maximal span to remove.

Against a bounded reference the shards' automata are broadcast (``MatchingStatistics``,
``remove_reference_spans``). When the corpus is its own reference they can't be, as
the corpus is unbounded. There each window of ``window`` words is dealt to a shard
by its minimizer, the smallest hash of the ``gram``-word runs inside it: equal
windows have equal minimizers, so all occurrences of a window meet in one shard and
each shard streams only its own documents' passages. Minimizers that occur once
can't be in a repeated window and end there; where all windows around a minimizer
are the same run of words, that run is repeated as a whole. Only passages around
minimizers with differing contexts reach automata. A minimizer in more than
``HOT`` places isn't gathered: runs with equal contexts are repeated as a whole, and
the windows of the others (and of one run of each such context, for all of them) are
counted one by one by 128-bit digests, which is exact and splits over tasks.

Keys that stand for many rows (a minimizer, a context or a digest of a passage in
many copies) are joined by broadcast in blocks, so no task gathers them.

Defined results: a null or empty text has no words and stays empty; texts shorter
than a window stay; a very long text is one row and streams through like others;
repeated rows are other places where a window starts; rows without doc_id count as
places and are cut like others; an empty table gives no rows; columns of any name
come through unchanged, but for text and, where there is one, n_chars.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnwise.llm.common import drop_written, slices, written
from turnwise.llm.wordhash import run_hashes, word_hashes

WINDOW = 35
GRAM = 8
#: Places of a minimizer up to which its passages are gathered in one shard.
HOT = 1000
#: Keys of frequent values that are broadcast at a time.
BLOCK = 200_000
#: Words of passages that a shard has on average.
SHARD_WORDS = 60_000


class SuffixAutomaton:
    """Suffix automaton over hashable symbols, with weighted numbers of occurrences.

    States are rows of parallel lists; transitions are a dict of each state.
    Sequences are added apart, so that no run reaches over an end.
    """

    def __init__(self) -> None:
        self.length, self.link, self.move, self.count = [0], [-1], [{}], [0]

    def _state(self, length: int, link: int, move: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.move.append(move)
        self.count.append(0)
        return len(self.length) - 1

    def _split(self, p: int, symbol, q: int) -> int:
        """The state for the runs of q that also end after p: a copy of q that is shorter."""
        copy = self._state(self.length[p] + 1, self.link[q], self.move[q].copy())
        self.link[q] = copy
        while p >= 0 and self.move[p].get(symbol) == q:
            self.move[p][symbol] = copy
            p = self.link[p]
        return copy

    def add(self, sequence, weight: int = 1) -> None:
        """Add one sequence that occurs ``weight`` times."""
        last = 0
        for symbol in sequence:
            p, q = last, self.move[last].get(symbol)
            if q is not None:
                last = q if self.length[q] == self.length[p] + 1 else self._split(p, symbol, q)
            else:
                last = self._state(self.length[p] + 1, 0, {})
                while p >= 0 and symbol not in self.move[p]:
                    self.move[p][symbol] = last
                    p = self.link[p]
                if p >= 0:
                    q = self.move[p][symbol]
                    self.link[last] = q if self.length[q] == self.length[p] + 1 else self._split(p, symbol, q)
            self.count[last] += weight

    def finish(self) -> SuffixAutomaton:
        """Carry the numbers of occurrences over to shorter runs."""
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.count[self.link[s]] += self.count[s]
        return self

    def matched(self, sequence, least: int, times: int) -> Iterator[int]:
        """Ends (exclusive) where a run of ``least`` symbols ends that occurs ``times`` times or more."""
        s, n = 0, 0
        for i, symbol in enumerate(sequence, 1):
            while s and symbol not in self.move[s]:
                s = self.link[s]
                n = self.length[s]
            s = self.move[s].get(symbol, 0)
            n = n + 1 if s else 0
            if n >= least:
                t = s
                while self.length[self.link[t]] >= least:
                    t = self.link[t]
                if self.count[t] >= times:
                    yield i


def spans(ends, length: int) -> list[tuple[int, int]]:
    """Maximal spans covered by runs of ``length`` with the given ascending ends."""
    out: list[tuple[int, int]] = []
    for e in ends:
        if out and e - length <= out[-1][1]:
            out[-1] = (out[-1][0], e)
        else:
            out.append((e - length, e))
    return out


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def remove_reference_spans(docs: DataFrame, reference: list[str], window: int = WINDOW, shard_words: int = 200_000) -> DataFrame:
    """doc_id, text without the spans of ``window`` words or more that a reference text holds.

    ``reference`` is a bounded list; its shards' automata are built on the driver and broadcast.
    """
    shards, room = [SuffixAutomaton()], shard_words
    for text in reference:
        words = words_of(text)
        if len(words) > room:
            shards.append(SuffixAutomaton())
            room = shard_words
        shards[-1].add(words)
        room -= len(words)
    shipped = docs.sparkSession.sparkContext.broadcast([s.finish() for s in shards])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                out = []
                for text in b.column(1).to_pylist():
                    words = words_of(text)
                    gone = [x for s in shipped.value for x in spans(s.matched(words, window, 1), window)]
                    out.append(None if text is None else b" ".join(_left(words, gone)).decode() if gone else text)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text string")


def _left(words: list[bytes], gone: list[tuple[int, int]]) -> list[bytes]:
    keep, at = [], 0
    for a, b in sorted(gone):
        if a > at:
            keep += words[at:a]
        at = max(at, b)
    return keep + words[at:] if gone else words


def window_runs(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, first window, number of windows) of each run of windows with one minimizer place."""
    n = len(h) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    g = run_hashes(h, np.arange(len(h) - gram + 1), gram)
    place = np.lib.stride_tricks.sliding_window_view(g, window - gram + 1).argmin(axis=1) + np.arange(n)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    return g[place[first]], first, np.diff(np.append(first, n))


_RUNS = "row long, minimizer long, first int, windows int, context long"


def _numbered(docs: DataFrame) -> DataFrame:
    """(row, text, doc): the input row as one struct, so that its names clash with none here.

    ``row`` is the doc_id, or a written number if ids are null or repeat.
    """
    rows = docs.select(F.col("doc_id").alias("row"), "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    if rows.groupBy("row").agg(F.count("*").alias("n")).where("n > 1 or row is null").head(1):
        return written(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    return rows


def split_join(left: DataFrame, right: DataFrame, on: list[str], hot: int, block: int = BLOCK) -> DataFrame:
    """Inner join where ``right`` (written) has each key once and in ``n`` the number of its rows in ``left``.

    Keys of over ``hot`` rows don't meet in one task: they go out by broadcast, ``block``
    of them at a time, and only the others are shuffled.
    """
    frequent = right.where(F.col("n") > hot)
    blocks, parts, rest = -(-frequent.count() // block), [], left
    for i in range(blocks):
        own = frequent.where(F.pmod(F.xxhash64(*on), F.lit(blocks)) == i)
        parts.append(left.join(F.broadcast(own), on))  # about ``block`` keys
        rest = rest.join(F.broadcast(own.select(*on)), on, "left_anti")
    out = rest.join(right.where(F.col("n") <= hot), on)
    for p in parts:
        out = out.unionByName(p)
    return out


def repeated_spans(rows: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(row, start, end): spans of words of repeated windows. rows: row, text."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                cols: list[list[np.ndarray]] = [[], [], [], [], []]
                for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    h = word_hashes((text or "").encode())
                    m, first, n = window_runs(h, window, gram)
                    if len(m):
                        for c, v in zip(cols, (np.full(len(m), row), m.view(np.int64), first, n, run_hashes(h, first, n + (window - 1)).view(np.int64)), strict=True):
                            c.append(v)
                if cols[0]:
                    kinds = (np.int64, np.int64, np.int32, np.int32, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(k)) for c, k in zip(cols, kinds, strict=True)], names=["row", "minimizer", "first", "windows", "context"])

    spark = rows.sparkSession
    places = written(rows.select("row", "text").mapInArrow(runs, _RUNS), "places")
    many = written(places.groupBy("minimizer").agg(F.count("*").alias("n"), F.min("context").alias("c0"), F.max("context").alias("c1")).where("n > 1"), "minimizers")
    marks = written(split_join(places, many, ["minimizer"], hot).select("row", "minimizer", "context", "first", "windows", F.when(F.col("c0") == F.col("c1"), 0).when(F.col("n") <= hot, 1).otherwise(2).alias("way")), "marks")
    drop_written(places, many)
    hot_runs = marks.where("way = 2")
    # equal contexts are equal runs, so their windows are as many
    contexts = written(hot_runs.groupBy("minimizer", "context").agg(F.count("*").alias("n"), F.min(F.struct("row", "first", "windows")).alias("one")), "contexts")
    whole = marks.where("way = 0").select("row", "first", "windows").union(split_join(hot_runs, contexts.where("n > 1").select("minimizer", "context", "n"), ["minimizer", "context"], hot).select("row", "first", "windows"))
    whole = whole.select("row", F.col("first").alias("start"), (F.col("first") + F.col("windows") + (window - 1)).alias("end"))
    alone = contexts.select("one.row", "one.first", "one.windows", "minimizer", F.lit(2).alias("way"), "n")
    mixed = marks.where("way = 1").select("row", "first", "windows", "minimizer", "way", F.lit(1).cast("long").alias("n")).union(alone)
    total = marks.where("way = 1").agg(F.coalesce(F.sum(F.col("windows") + (window - 1)), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, -(-int(total) // SHARD_WORDS))
    per_row = mixed.groupBy("row").agg(F.collect_list(F.struct("first", "windows", "minimizer", "way", "n")).alias("marks"))  # at most a text's windows
    wanted = rows.select("row", "text").join(per_row.hint("shuffle_hash"), "row")

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, 64):
                out: list[tuple] = []
                for row, text, marked in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    words = words_of(text)
                    for x in marked:
                        at, n = x["first"], x["windows"]
                        if x["way"] == 1:
                            out.append((row, at, (x["minimizer"] & (2**63 - 1)) % shards, None, b" ".join(words[at : at + n + window - 1]), 1))
                        else:
                            out += [(row, i, -1, hashlib.blake2b(b" ".join(words[i : i + window]), digest_size=16).digest(), None, x["n"]) for i in range(at, at + n)]
                c = list(zip(*out, strict=True)) or [()] * 6
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(c, kinds, strict=True)], names=["row", "first", "shard", "digest", "words", "times"])

    cut = written(wanted.select("row", "text", "marks").mapInArrow(passages, "row long, first int, shard long, digest binary, words binary, times long"), "passages")

    def automata(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One shard after the other; rows come sorted by shard."""

        def solve(held: dict[bytes, list[tuple[int, int]]]) -> pa.RecordBatch:
            sam = SuffixAutomaton()
            for text, at in held.items():
                sam.add(text.split(), len(at))
            sam.finish()
            out = [(row, first + a, first + b) for text, at in held.items() for a, b in spans(sam.matched(text.split(), window, 2), window) for row, first in at]
            c = list(zip(*out, strict=True)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int32())], names=["row", "start", "end"])

        shard, held = None, {}
        for batch in batches:
            for row, first, own, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != shard and held:
                    yield solve(held)
                    held = {}
                shard = own
                held.setdefault(text, []).append((row, first))
        if held:
            yield solve(held)

    cold = cut.where("words is not null").select("row", "first", "shard", "words").repartition("shard").sortWithinPartitions("shard").mapInArrow(automata, "row long, start int, end int")
    windows = cut.where("digest is not null").select("row", "first", "digest", "times")
    twice = written(windows.groupBy("digest").agg(F.sum("times").alias("times"), F.count("*").alias("n")).where("times > 1").select("digest", "n"), "digests")
    counted = split_join(windows, twice, ["digest"], hot).select("row", F.col("first").alias("start"), (F.col("first") + window).alias("end"))
    return whole.union(cold).union(counted)


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the words that stay, joined by one space)."""
    kinds = [("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    out = _cut(docs.select("doc_id", "text"), window, gram, hot, kinds, lambda text, words, left, joined: (len(words), len(words) - len(left), hashlib.sha256(joined).hexdigest()))
    return out.select("doc.doc_id", *(n for n, _ in kinds))


def deduplicated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """The rows with their other columns; a text that loses words is its other words joined by one space.

    A row whose text lost all its words is left out; one that had none stays.
    """
    kinds = [("cut", pa.string()), ("gone", pa.bool_())]
    out = _cut(docs, window, gram, hot, kinds, lambda text, words, left, joined: (text if len(left) == len(words) else joined.decode(), len(left) < len(words) and not left))
    own = {"text": F.col("cut").alias("text"), "n_chars": F.when(F.col("cut").isNull(), F.col("doc.n_chars")).otherwise(F.length("cut").cast(docs.schema["n_chars"].dataType)).alias("n_chars") if "n_chars" in docs.columns else None}
    return out.where("not gone").select(*(own.get(c, F.col(f"doc.`{c}`")) for c in docs.columns))


def _cut(docs: DataFrame, window: int, gram: int, hot: int, kinds: list, each) -> DataFrame:
    """(doc, ...): the input rows as structs, with columns that ``each`` makes of (text, words, words left, those joined)."""
    rows = _numbered(docs)
    gone = repeated_spans(rows, window, gram, hot).groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = rows.join(gone.hint("shuffle_hash"), "row", "left").select("doc", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                out = []
                for text, marked in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    words = words_of(text)
                    left = _left(words, [(x["start"], x["end"]) for x in marked or ()])
                    out.append(each(text, words, left, b" ".join(left)))
                cols = list(zip(*out, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, (_, k) in zip(cols, kinds, strict=True))], names=["doc", *(n for n, _ in kinds)])

    types = {pa.int64(): T.LongType(), pa.string(): T.StringType(), pa.bool_(): T.BooleanType()}
    return joined.mapInArrow(run, T.StructType([joined.schema["doc"], *(T.StructField(n, types[k]) for n, k in kinds)]))
