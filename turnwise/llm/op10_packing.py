"""Packing: shortest-pack-first over the length histogram.

Documents become token pieces of at most ``max_tokens``. The histogram of piece
lengths (never the pieces) goes to the driver; lengths are placed longest first,
each into the pattern with the least tokens that still leaves room, and pattern
counts are split as they fill up. Patterns are joined back to pieces by the rank
of a piece among the pieces of its length.

Defined results: a null or empty text is one piece that holds only the end id; a
very long text is as many pieces as it takes; equal documents and repeated rows give
equal pieces in different places; rows without doc_id are packed like others; of
pieces of one length, which goes where follows their order in the input, not their
content; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import bisect
import heapq
import itertools
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnwise.llm.common import slices, written

MAX_TOKENS = 2048
END_ID = 1
#: Distinct chunks of one kind that a worker keeps encoded; when full, the half that came first (the frequent ones) stays.
CACHE_CHUNKS = 200_000
#: Characters of the longest chunk that is kept.
CACHE_LENGTH = 64
#: White space but space and line end, as Python has it, and signs that other libraries once counted as such.
_OTHER = [chr(c) for c in range(0x110000) if chr(c).isspace() and c not in (10, 32)] + ["\u180e", "\u200b", "\u200c", "\u200d", "\u2060", "\ufeff"]
_OTHER_ASCII = [c for c in _OTHER if c < "\x80"]
_STATE: dict = {}


class _Chunks(dict):
    """Encoded chunks by text without the white space before them; misses are encoded and kept within bounds."""

    def __init__(self, lead: str, encode) -> None:
        super().__init__()
        self.lead, self.encode = lead, encode

    def __missing__(self, chunk: str) -> bytes:
        ids = self.encode(self.lead + chunk)
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(chunk) <= CACHE_LENGTH:
            if len(self) >= CACHE_CHUNKS:
                first = list(itertools.islice(self.items(), CACHE_CHUNKS // 2))
                self.clear()
                self.update(first)
            self[chunk] = out
        return out


def _load(path: str, ranks_path: str) -> dict:
    if _STATE.get("path") != path:
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _STATE.update(path=path, whole=None, **{k: _Chunks(lead, fast.encode_ordinary) for k, lead in (("first", ""), ("space", " "), ("line", "\n"))})
    return _STATE


def _whole(state: dict, text: str) -> list[int]:
    """Ids by the tokenizer library, which is loaded when a text first needs it."""
    if state["whole"] is None:
        from tokenizers import Tokenizer

        state["whole"] = Tokenizer.from_file(state["path"])
    return state["whole"].encode(text, add_special_tokens=False).ids


def single_blanks(text: str) -> bool:
    """Whether all white space of a text is single spaces and line ends, none at its end and no two side by side."""
    if text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return False
    return not any(c in text for c in (_OTHER_ASCII if text.isascii() else _OTHER))


def encode_packed(texts: list[str | None], path: str, ranks_path: str) -> list[bytes]:
    """Ids of each text as little-endian 32-bit words, without the end id.

    Where single spaces and single line ends are a text's only white space (see
    ``single_blanks``), it is cut before each of them: pre-tokens never reach across
    such a place, so the chunks are encoded apart (by the same vocabulary as ranks)
    and remembered. Any other text, and one that may hold a special token, is encoded
    whole.
    """
    state = _load(path, ranks_path)
    first, space, line = state["first"], state["space"], state["line"]
    out = []
    for text in texts:
        if not text:
            out.append(b"")
            continue
        if "<|" in text or not single_blanks(text):
            ids = _whole(state, text)
            out.append(struct.pack(f"<{len(ids)}I", *ids))
            continue
        rows = [x.split(" ") for x in text.split("\n")]
        parts = [first[rows[0][0]]]
        parts += map(space.__getitem__, rows[0][1:])
        for row in rows[1:]:
            parts.append(line[row[0]])
            parts += map(space.__getitem__, row[1:])
        out.append(b"".join(parts))
    return out


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())])


def token_pieces(docs: DataFrame, tokenizer_path: str, ranks_path: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """One row per piece; ``part`` and ``nth`` number the pieces of a length within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, end = TaskContext.get().partitionId(), [0] * (max_tokens + 1), struct.pack("<I", END_ID)
        for batch in batches:
            for b in slices(batch):
                rows: list[list[int]] = [[], [], [], [], [], []]
                for doc, ids in zip(b.column(0).to_pylist(), encode_packed(b.column(1).to_pylist(), tokenizer_path, ranks_path), strict=True):
                    ids += end
                    n = len(ids) // 4
                    for at in range(0, n, max_tokens):
                        size = min(max_tokens, n - at)
                        for col, v in zip(rows, (doc, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), n, seen[size]), strict=True):
                            col.append(v)
                        seen[size] += 1
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in rows[:5]), pa.array([part] * len(rows[0]), pa.int32()), pa.array(rows[5], pa.int64())], schema=_PIECES)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long")


def shortest_pack_first(histogram: dict[int, int], max_tokens: int = MAX_TOKENS) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) patterns. Lengths go longest first into the shortest fitting pattern.

    Work is over distinct lengths and patterns, so it doesn't grow with the corpus.
    """
    open_: dict[int, list[list]] = {}  # tokens used -> [count, lengths]
    heap: list[int] = []
    done: list[tuple[int, tuple[int, ...]]] = []

    def add(used: int, count: int, lengths: tuple[int, ...]) -> None:
        if used == max_tokens:
            done.append((count, lengths))
            return
        if used not in open_:
            open_[used] = []
            heapq.heappush(heap, used)
        open_[used].append([count, lengths])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            while heap and not open_.get(heap[0]):
                open_.pop(heapq.heappop(heap), None)
            # the shortest pack has most room: if it doesn't fit there, it fits nowhere
            if heap and heap[0] + length <= max_tokens:
                used = heap[0]
                count, lengths = open_[used].pop()
                take = min(count, left)
                if take < count:
                    open_[used].append([count - take, lengths])
                add(used + length, take, (*lengths, length))
                left -= take
            else:
                fits = max_tokens // length  # open packs hold equal lengths from the start
                for per in range(fits, 0, -1):
                    packs, left = divmod(left, per)
                    if packs:
                        add(per * length, packs, (length,) * per)
    done += [(count, lengths) for packs in open_.values() for count, lengths in packs]
    return sorted(done, key=lambda p: (-sum(p[1]), tuple(-x for x in p[1]), -p[0]))


def placements(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[int, list[tuple[int, int, int]]]:
    """For each length, (first rank, first sequence, offset), by first rank: rank r sits in sequence first + r - first rank."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    base = 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            first = ranks.get(length, 0)
            out.setdefault(length, []).append((first, base, offset))
            ranks[length] = first + count
            offset += length
        base += count
    return out


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Pieces with their place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = written(token_pieces(docs, tokenizer_path, ranks_path, max_tokens), "pieces")
    per_task = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most max_tokens rows
    places = placements(shortest_pack_first(histogram, max_tokens))
    before = per_task.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = pieces.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    shipped = docs.sparkSession.sparkContext.broadcast(places)  # a few thousand entries: bounded by max_tokens
    schema = pa.schema([*[_PIECES.field(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")], ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {k: ([x[0] for x in v], v) for k, v in shipped.value.items()}
        for b in batches:
            seq, off = [], []
            for length, rank in zip(b.column(2).to_pylist(), b.column(5).to_pylist(), strict=True):
                firsts, rows = table[length]
                first, base, offset = rows[bisect.bisect_right(firsts, rank) - 1]
                seq.append(base + rank - first)
                off.append(offset)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq, pa.int64()), pa.array(off, pa.int64())], schema=schema)

    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
