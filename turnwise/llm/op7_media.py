"""Media columns: signature sniffing.

An Aho-Corasick automaton finds magic bytes; a validator of each format then
confirms structure and lengths. A declared type that the bytes contradict is
corrected, and whole files embedded in others are carved.

Defined results: null bytes have no type and nothing embedded; an empty value has
no type; a magic that its validator rejects is no find; finds inside a carved
file are reported too, by offset; ties at one offset go to the longest find; equal
values and repeated rows have equal results; rows without key are kept; a very long
value is scanned once for magics and once for each end mark; an empty table gives no
rows; other columns of the input are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from turnwise.llm.common import slices

BLOCK = 64
SAMPLE_RATE = 8000


def _next(d: memoryview, mark: bytes, at: int) -> int:
    """First place of ``mark`` from ``at`` on, or -1. A value's places are found once, in one scan."""
    if _SCAN.get("of") is not d:
        _SCAN.clear()
        _SCAN["of"] = d
    places = _SCAN.get(mark)
    if places is None:
        places = _SCAN[mark] = [m.start() for m in re.finditer(re.escape(mark), d)]
    i = bisect.bisect_left(places, at)
    return places[i] if i < len(places) else -1


def _riff(d: memoryview, at: int) -> int:
    """Length of the WAVE file at ``at``: its chunks must fill the size that its header states."""
    if len(d) < at + 12 or bytes(d[at + 8 : at + 12]) != b"WAVE":
        return 0
    end = at + 8 + struct.unpack_from("<I", d, at + 4)[0]
    pos, seen = at + 12, set()
    while pos + 8 <= min(end, len(d)):
        seen.add(bytes(d[pos : pos + 4]))
        pos += 8 + (size := struct.unpack_from("<I", d, pos + 4)[0]) + size % 2
    return end - at if pos == end <= len(d) and {b"fmt ", b"data"} <= seen else 0


def _png(d: memoryview, at: int) -> int:
    pos, first = at + 8, True
    while pos + 12 <= len(d):
        size, kind = struct.unpack_from(">I4s", d, pos)
        if pos + 12 + size > len(d) or first != (kind == b"IHDR") or zlib.crc32(d[pos + 4 : pos + 8 + size]) != struct.unpack_from(">I", d, pos + 8 + size)[0]:
            return 0
        pos, first = pos + 12 + size, False
        if kind == b"IEND":
            return pos - at
    return 0


def _bmp(d: memoryview, at: int) -> int:
    if len(d) < at + 54:
        return 0
    size, _, start, header, wide, high, planes, bits = struct.unpack_from("<IIIIiiHH", d, at + 2)
    row = (abs(wide) * bits + 31) // 32 * 4
    return size if header >= 40 and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and 54 <= start <= size <= len(d) - at and start + row * abs(high) == size else 0


def _gif(d: memoryview, at: int) -> int:
    if len(d) < at + 14:
        return 0

    def blocks(pos: int) -> int:
        while pos < len(d) and d[pos]:
            pos += d[pos] + 1
        return pos + 1

    pos = at + 13 + (3 << ((d[at + 10] & 7) + 1)) * (d[at + 10] >> 7)
    while pos < len(d):
        if d[pos] == 0x3B:
            return pos + 1 - at
        if d[pos] == 0x21:
            pos = blocks(pos + 2)
        elif d[pos] == 0x2C and pos + 10 < len(d):
            pos = blocks(pos + 11 + (3 << ((d[pos + 9] & 7) + 1)) * (d[pos + 9] >> 7))
        else:
            return 0
    return 0


def _zip(d: memoryview, at: int) -> int:
    if len(d) < at + 30:
        return 0
    end = _next(d, b"PK\x05\x06", at) - at
    if end < 0 or at + end + 22 > len(d):
        return 0
    size, start, note = struct.unpack_from("<IIH", d, at + end + 12)
    return end + 22 + note if start + size == end and at + end + 22 + note <= len(d) else 0


def _gzip(d: memoryview, at: int) -> int:
    if len(d) < at + 18 or d[at + 2] != 8 or d[at + 3] > 31:
        return 0
    z, pos = zlib.decompressobj(31), at
    try:
        while pos < len(d) and not z.eof:
            z.decompress(d[pos : pos + 65536])
            pos += 65536
    except zlib.error:
        return 0
    return min(pos, len(d)) - len(z.unused_data) - at if z.eof else 0


def _pdf(d: memoryview, at: int) -> int:
    end, table = _next(d, b"%%EOF", at), _next(d, b"startxref", at)
    return end + 5 - at if 0 <= table <= end - 9 else 0


def _jpeg(d: memoryview, at: int) -> int:
    pos = at + 2
    while pos + 4 <= len(d) and d[pos] == 0xFF:
        kind, size = d[pos + 1], struct.unpack_from(">H", d, pos + 2)[0]
        if kind == 0xDA:
            end = _next(d, b"\xff\xd9", pos)
            return end + 2 - at if end > 0 else 0
        if kind < 0xC0 or size < 2:
            return 0
        pos += 2 + size
    return 0


#: Magic bytes and what confirms them. Fixed values of the formats.
FORMATS = [
    (b"RIFF", "audio/wav", _riff),
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"BM", "image/bmp", _bmp),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"\x1f\x8b", "application/gzip", _gzip),
    (b"%PDF-", "application/pdf", _pdf),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
]
_STATE: dict = {}
#: Places of end marks in the value at hand.
_SCAN: dict = {}


def finds(data: bytes) -> list[tuple[str, int, int]]:
    """(type, offset, length) of each confirmed file in ``data``, by offset."""
    if "ac" not in _STATE:
        import ahocorasick

        ac = ahocorasick.Automaton()
        for i, (magic, _, _) in enumerate(FORMATS):
            ac.add_word(magic.decode("latin-1"), i)
        ac.make_automaton()
        _STATE["ac"] = ac
    view, out = memoryview(data), []
    for last, i in _STATE["ac"].iter(data.decode("latin-1")):
        magic, kind, valid = FORMATS[i]
        at = last + 1 - len(magic)
        if size := valid(view, at):
            out.append((kind, at, size))
    _SCAN.clear()
    return sorted(out, key=lambda x: (x[1], -x[2], x[0]))


def judged(found: list[tuple[str, int, int]], declared: str | None) -> tuple[str | None, bool, list[tuple[str, int, int]]]:
    """Type of the whole value, whether that corrects the declared one, and the embedded files, from its finds."""
    whole = next((kind for kind, at, _ in found if at == 0), None)
    return whole, whole is not None and whole != declared, [x for x in found if x[1] > 0]


def sniff(data: bytes | None, declared: str | None = None) -> tuple[str | None, bool, list[tuple[str, int, int]]]:
    """``judged`` of a value's bytes."""
    return judged(finds(data) if data else [], declared)


def sniff_column(df: DataFrame, key: str, data: str, declared: str) -> DataFrame:
    """key, media_type, corrected, embedded(type, offset, length, bytes) of a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("bytes", pa.binary())]))
        for batch in batches:
            for b in slices(batch, 64):
                got = [(sniff(d, t), d) for d, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
                inner = [[{"type": k, "offset": at, "length": n, "bytes": d[at : at + n]} for k, at, n in x[2]] for x, d in got]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x, _ in got], pa.string()), pa.array([x[1] for x, _ in got]), pa.array(inner, kind)], names=["key", "media_type", "corrected", "embedded"])

    kind = df.schema[key].dataType.simpleString()
    return df.selectExpr(f"`{key}` as key", f"`{data}` as data", f"cast(`{declared}` as string) as declared").mapInArrow(run, f"key {kind}, media_type string, corrected boolean, embedded array<struct<type string, offset long, length long, bytes binary>>")


def to_wav(payload: bytes) -> bytes:
    """8-bit mono samples: the payload's bytes are the samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8, b"data", len(payload)) + payload


def from_wav(media: bytes) -> bytes:
    """The samples of a file that ``finds`` has confirmed: those of its data chunk."""
    pos = 12
    while media[pos : pos + 4] != b"data":
        pos += 8 + (size := struct.unpack_from("<I", media, pos + 4)[0]) + size % 2
    return media[pos + 8 : pos + 8 + struct.unpack_from("<I", media, pos + 4)[0]]


def to_png(payload: bytes) -> bytes:
    """An 8-bit grey image of 64 samples a row; its rows are stored as they are."""
    chunk = lambda kind, d: struct.pack(">I", len(d)) + kind + d + struct.pack(">I", zlib.crc32(kind + d))
    rows = b"".join(b"\0" + payload[i : i + BLOCK] for i in range(0, len(payload), BLOCK))
    head = struct.pack(">IIBBBBB", BLOCK, len(payload) // BLOCK, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows, 0)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of an image that ``to_png`` made."""
    pos, held = 8, []
    while pos < len(media):
        size, kind = struct.unpack_from(">I4s", media, pos)
        if kind == b"IDAT":
            held.append(media[pos + 8 : pos + 8 + size])
        pos += 12 + size
    rows = zlib.decompress(b"".join(held))
    return b"".join(rows[i : i + BLOCK] for i in range(1, len(rows), BLOCK + 1))


def to_zip(media: bytes, name: bytes = b"a") -> bytes:
    """An archive that holds a file uncompressed, so that it can be carved."""
    crc, n = zlib.crc32(media), len(media)
    entry = struct.pack("<HHHHHIIIHH", 20, 0, 0, 0, 33, crc, n, n, len(name), 0)
    local = b"PK\x03\x04" + entry + name + media
    central = b"PK\x01\x02" + struct.pack("<H", 20) + entry + struct.pack("<HHHII", 0, 0, 0, 0, 0) + name
    return local + central + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 1, 1, len(central), len(local), 0)


READERS = {"audio/wav": from_wav, "image/png": from_png}
DECLARED = ["audio/wav", "image/png", "application/zip", "application/octet-stream"]


def stored(payload: bytes) -> tuple[bytes, str]:
    """The stored form of a payload and the type declared for it, both by the payload's own checksum.

    One of three forms: samples of sound, an image, or an archive around such sound. The
    declared type is right by chance only, as in real uploads it may be wrong.
    """
    c = zlib.crc32(payload)
    return (to_wav(payload), to_png(payload), to_zip(to_wav(payload)))[c % 3], DECLARED[c // 3 % len(DECLARED)]


def read_back(media: bytes, found: list[tuple[str, int, int]]) -> bytes:
    """The payload of a stored value, from the first file that ``finds`` has confirmed and that holds samples."""
    for kind, at, size in found:
        if kind in READERS:
            return READERS[kind](media[at : at + size])
    raise ValueError("no file with samples was recognised in a stored value")


def media_features(docs: DataFrame) -> DataFrame:
    """Store each text as samples, sniff the stored bytes, read them back, digest them.

    A null text counts as empty; the payload is padded with zero bytes to a positive
    multiple of 64. ``feature`` names the sniffed type, the declared one and whether it
    is corrected, the sniffed length, and embedded files by place and length.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def one(text: str | None) -> tuple:
        raw = (text or "").encode()
        media, declared = stored(raw + bytes(-len(raw) % BLOCK if raw else BLOCK))
        found = finds(media)
        kind, corrected, inner = judged(found, declared)
        payload = read_back(media, found)
        size = next(n for k, at, n in found if at == 0)
        feature = f"{kind}@0+{size};declared={declared};corrected={int(corrected)};embedded={len(inner)}" + "".join(f";{k}@{at}+{n}" for k, at, n in inner)
        return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for b in slices(batch):
                cols = list(zip(*map(one, b.column(1).to_pylist()), strict=True)) or [()] * 7
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
