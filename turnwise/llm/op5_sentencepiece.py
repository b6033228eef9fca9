"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The model file is compiled into three machines. The normaliser has one state that
reads a character and writes it, or the space sign for a blank, and before it a state
that writes a space sign and reads nothing. The pieces are a trie that reads a piece's
characters, writes its id and returns to its root. Byte fallback is an arc of the
root for each character that is no piece: it writes the character's bytes. They are
composed once: as the normaliser writes one sign an arc, the composed machine is the
trie whose arcs read what the normaliser reads to write their sign.

An input composed with this machine is a lattice: its states are places in the text,
its arcs pieces or fallback bytes. The encoding is its shortest path in the tropical
semiring (sums along a path, minimum over paths). In a unigram model an arc weighs
minus its piece's score, and the path is found place by place. In a byte-pair model
a path is the encoding just if each two neighbours on it are what merging gives for
their own text: an arc after another weighs nothing if they are and infinity if not,
so the first whole path of finite weight is a shortest one. Merging a prefix has one
result, so a place has one last piece of finite weight and need not be split by it.
Decoding inverts the machines: ids to bytes, bytes to text.

Where no piece reaches from a character over a following space sign, a text is cut
there and each part encoded once per worker while it is remembered; else it is one part.

Defined results: a null text gives null ids and decodes to null; an empty one gives
no ids; ties take the path with the longer last piece; repeated rows and rows without
doc_id are encoded like others; a very long text goes part by part; an empty table
gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from turnwise.llm.common import slices

SPACE = "▁"
#: Parts that a worker keeps encoded; when full, the first half stays.
CACHE_PARTS = 350_000
#: Signs of a part up to which it is remembered.
CACHE_SIGNS = 100
#: What the composed machine reads where the normaliser reads nothing: no character equals it.
START = "start"
_PART = re.compile(f"[ {SPACE}]*[^ {SPACE}]+|[ {SPACE}]+")
_WHOLE = re.compile("(?s).+")
_STATE: dict = {}
_INF = float("inf")


def read_model(path: str) -> dict:
    """Pieces, scores and kinds of a model file, and what its normaliser does."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    norm = proto.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
        raise ValueError("only models with an identity normaliser that keeps white space are compiled")
    if any(p.type in (4, 5) for p in proto.pieces):
        raise ValueError("pieces that are user-defined or unused are not compiled")
    return {"pieces": [(p.piece, p.score, p.type) for p in proto.pieces], "prefix": norm.add_dummy_prefix, "unigram": proto.trainer_spec.model_type == 1}


class Transducer:
    """Normaliser, pieces and byte fallback of one model, composed; inputs are composed on demand."""

    def __init__(self, model: dict) -> None:
        self.model, self.pieces, self.score = model, {}, {}
        self.bytes: dict[int, int] = {}
        self.text: list[str | None] = []
        for i, (piece, score, kind) in enumerate(model["pieces"]):
            self.text.append(piece if kind == 1 else None)
            if kind == 1:
                self.pieces[piece] = i
                self.score[i] = score
            elif kind == 6:
                self.bytes[int(piece[3:-1], 16)] = i
            elif kind == 2:
                self.unknown = i
        self.writes = {" ": SPACE, START: SPACE}  # the normaliser; it writes other characters as they are
        self.root = self._composed({SPACE: (SPACE, " ", START)})
        self.part = _WHOLE if any(SPACE in p.lstrip(SPACE) for p in self.pieces) else _PART
        back = {i: bytes([b]) for b, i in self.bytes.items()}
        self.raw = [back.get(i, (t or "").encode()) for i, t in enumerate(self.text)]
        self.fallback = 10.0 - min(self.score.values(), default=0.0)  # what the library takes off for a sign that no piece holds
        self.pairs: dict[int, float] = {}
        self.known: dict[str | tuple[str, ...], tuple[int, ...]] = {}

    def _composed(self, reads: dict[str, tuple[str, ...]]) -> dict:
        """The trie of the pieces behind the normaliser, given by what it reads for each sign that it writes."""
        root: dict = {}
        for piece, i in self.pieces.items():
            node = root
            for c in piece:
                labels = reads.get(c, (c,))
                following = node.setdefault(labels[0], {})
                node.update((r, following) for r in labels[1:])
                node = following
            node[""] = i
        return root

    def _merged(self, text: str) -> list[str]:
        """What merging makes of a short text: the best-scored neighbours first, the leftmost of equals."""
        parts = list(text)
        while True:
            at = [(-self.score[self.pieces[a + b]], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.pieces]
            if not at:
                return parts
            i = min(at)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _pair(self, left: int, right: int) -> float:
        """Nothing if merging the text of two pieces (without a left one, of the right) gives just these, else infinity."""
        a, b = ([] if left < 0 else [self.text[left]]), self.text[right]
        self.pairs[left * len(self.text) + right] = w = 0.0 if self._merged("".join(a) + b) == [*a, b] else _INF
        return w

    def _fallen(self, sign: str) -> list[int]:
        """What the fallback arc that reads a sign writes."""
        return [self.bytes[b] for b in self.writes.get(sign, sign).encode()] if self.bytes else [self.unknown]

    def _arcs(self, chain: str | tuple[str, ...], at: int) -> list[tuple[int, int]]:
        """(end, piece) of the arcs that begin at a place, shortest first; piece -1 is the fallback."""
        node, end, size = self.root.get(chain[at]), at + 1, len(chain)
        out = [(end, -1)] if node is None or "" not in node else []
        while node is not None:
            if "" in node:
                out.append((end, node[""]))
            if end == size:
                break
            node = node.get(chain[end])
            end += 1
        return out

    def _first_path(self, chain: str | tuple[str, ...]) -> list[tuple[int, int]]:
        """(place, piece) arcs of a shortest path where finite weights are nothing: the first whole path, longest arcs first."""
        size, n, pairs, dead = len(chain), len(self.text), self.pairs, set()
        path: list[tuple[int, int]] = []
        at, left, arcs, open_ = 0, -1, self._arcs(chain, 0), []
        while True:
            while arcs:
                end, piece = arcs.pop()
                if end in dead:
                    continue
                if piece >= 0:
                    w = pairs.get(left * n + piece)
                    if (self._pair(left, piece) if w is None else w) == _INF:
                        continue
                path.append((at, piece))
                if end == size:
                    return path
                open_.append((at, left, arcs))
                at, left, arcs = end, piece, self._arcs(chain, end)
            # a place has one last piece of finite weight, so what led nowhere once always does
            dead.add(at)
            if not open_:
                raise ValueError("no path: the pieces don't cover the text")
            at, left, arcs = open_.pop()
            path.pop()

    def _least_path(self, chain: str | tuple[str, ...]) -> list[tuple[int, int]]:
        """(place, piece) arcs of the shortest path where an arc weighs minus its piece's score, place by place."""
        size = len(chain)
        dist, back = [0.0] + [_INF] * size, [(-1, -1)] * (size + 1)
        for at in range(size):
            for end, piece in self._arcs(chain, at):
                w = dist[at] + (-self.score[piece] if piece >= 0 else self.fallback)
                if w < dist[end]:
                    dist[end], back[end] = w, (at, piece)
        path, at = [], size
        while at > 0:
            path.append(back[at])
            at = back[at][0]
        return path[::-1]

    def shortest(self, chain: str | tuple[str, ...]) -> tuple[int, ...]:
        """Ids on the shortest path through an input, given as the signs that the composed machine reads."""
        out: list[int] = []
        for at, piece in self._least_path(chain) if self.model["unigram"] else self._first_path(chain):
            if piece >= 0:
                out.append(piece)
            else:
                out += self._fallen(chain[at])
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        if len(self.known) > CACHE_PARTS:
            self.known = dict(list(self.known.items())[: CACHE_PARTS // 2])
        if len(self.pairs) > 4 * CACHE_PARTS:
            self.pairs.clear()
        known, out = self.known, []
        parts: list = self.part.findall(text)
        if parts and self.model["prefix"]:
            parts[0] = (START, *parts[0])
        for part in parts:
            ids = known.get(part)
            if ids is None:
                ids = self.shortest(part)
                if len(part) <= CACHE_SIGNS:
                    known[part] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become the replacement sign."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.model["prefix"] and text.startswith(" ") else text


def transducer(path: str) -> Transducer:
    if _STATE.get("path") != path:
        _STATE.update(path=path, machine=Transducer(read_model(path)))
    return _STATE["machine"]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array<int>) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = transducer(path)
        for batch in batches:
            for b in slices(batch, 128):
                ids = [None if t is None else m.encode(t) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id, text from doc_id, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = transducer(path)
        for batch in batches:
            for b in slices(batch, 128):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if i is None else m.decode(i) for i in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian 32-bit ids), decoded_sha256, same (decodes to the text) of every whole text.

    A text that holds the space sign itself decodes with a space in its place, as
    the normaliser can't tell them apart: ``same`` is false there.
    """

    def one(m: Transducer, text: str | None) -> tuple:
        if text is None:
            return None, None, None, None
        ids = m.encode(text)
        back = m.decode(ids)
        return len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)), hashlib.sha256(back.encode()).hexdigest(), back == text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = transducer(path)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        for batch in batches:
            for b in slices(batch, 128):
                cols = list(zip(*(one(m, t) for t in b.column(1).to_pylist()), strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "same"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, same boolean")
