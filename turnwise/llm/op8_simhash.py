"""SimHash near-dedup with pivot distance tables.

Texts become 64-bit fingerprints; equal fingerprints are one node. Two fingerprints
that differ in at most two bits agree in two of their four 16-bit blocks, so nodes
meet in buckets of such block pairs. Within a bucket, Hamming distances to many
reference fingerprints (pivots) are tabled; by the triangle inequality a pair whose
distances to any pivot differ by more than two bits is discarded, and survivors are
verified. A bucket yields its components as stars around their smallest node, never all
pairs.

A bucket of more than ``BUCKET`` nodes takes an exact way of linear cost: two
fingerprints are within two bits just if they share a value that is within one bit
of both, so every node is listed under its 65 such values, at most 65 to a value.

``similar_documents`` is the form for near copies: a SimHash of 1,024 bits over the set of
five-word shingles. At that width a similarity (Jaccard) of 0.8 is 155 differing bits on
average, and ``LIMIT`` takes 999 in 1,000 of such pairs by calculation (four of five
shingles differ in more bits and have ``TINY``). Blocks of equal bits can't find so wide a
radius, so nodes meet in ten buckets of three MinHashes each (0.8: 999 in 1,000 pairs
meet). There pivots are taken from the bucket itself, as fixed ones lie equally far from
everything; the triangle inequality discards, XOR verifies, pairs already in one component
are skipped. The components of that are candidates only: within each, pairs are compared
again by the exact Jaccard of their shingle sets (hashed to 64 bits), and only those of
0.8 or more are links.

Defined results: a null text or one without words has fingerprint zero and is linked
like any other; fewer words than a shingle make one shingle of all; repeated rows
count once more; a row without id has no component of its own and links nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import drop_written, slices, written
from turnwise.llm.graph import components
from turnwise.llm.wordhash import mix, run_hashes, word_hashes

SHINGLE = 3
RADIUS = 2
SEED = 42
PIVOTS = 24
#: Nodes of a bucket that one task compares.
BUCKET = 16_384
#: Near copies: words of a shingle, least similarity, bits, the most that may differ (and where no text has over five shingles), MinHashes as buckets by rows.
NEAR_SHINGLE, SIMILARITY, WIDTH, LIMIT, TINY = 5, 0.8, 1024, 200, 232
#: Shingles a node of a full bucket has, where sets of shingles are compared.
SET = 256
BANDS, ROWS = 10, 3
_BLOCKS = [(i, j) for i in range(4) for j in range(i + 1, 4)]


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints from a rule (a Weyl sequence, mixed)."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the XXH64 of the text's word shingles, repeats included."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z only, and ASCII white space
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), max(1, len(words) - shingle + 1)
    for at in range(0, n, 16_384):
        part = words[at : at + 16_384 + shingle - 1]
        grams = zip(*(part[k:] for k in range(shingle)), strict=False) if len(words) >= shingle else [words]
        h = np.array([digest(b" ".join(g), SEED) for g in grams], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every whole text; fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def bucket_links(key: np.ndarray, fp: np.ndarray, node: np.ndarray, refs: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """The links within buckets as stars: each linked node with the first of its component. Rows are sorted by key."""
    table = np.bitwise_count(fp[None, :] ^ refs[:, None]).astype(np.int8)
    parent, label = list(range(len(key))), np.arange(len(key))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    i, step = np.arange(len(key)), 0
    while True:
        step += 1
        i = i[i + step < len(key)]
        i = i[key[i] == key[i + step]]
        if not len(i):
            break
        a = i
        for d in table:
            a = a[np.abs(d[a] - d[a + step]) <= radius]
        a = a[np.bitwise_count(fp[a] ^ fp[a + step]) <= radius]
        a = a[label[a] != label[a + step]]
        joined = False
        for x in a.tolist():
            p, q = find(x), find(x + step)
            if p != q:
                parent[max(p, q)] = min(p, q)
                joined = True
        if joined:
            hold = np.array(parent)
            while (nxt := hold[hold]).tobytes() != hold.tobytes():
                hold = nxt
            label = hold
    at = np.flatnonzero(label != np.arange(len(key)))
    return node[at], node[label[at]]


def links(nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between nodes (fp, node) whose components are those of all pairs within two bits."""

    def block(i: int):
        return F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))

    keys = [F.lit(k << 32).bitwiseOR(F.shiftleft(block(i), 16)).bitwiseOR(block(j)) for k, (i, j) in enumerate(_BLOCKS)]
    dealt = nodes.where("node is not null").select(F.explode(F.array(*keys)).alias("key"), "fp", "node")
    large = written(dealt.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > bucket).select("key"), "large")
    refs = pivots()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.empty(0, np.int64)] * 3

        def emit(cols: list[np.ndarray]) -> pa.RecordBatch:
            a, b = bucket_links(cols[0], cols[1].astype(np.uint64), cols[2], refs)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            cols = [np.concatenate((h, c.to_numpy(zero_copy_only=False))) for h, c in zip(held, batch.columns, strict=True)]
            if not len(cols[0]):
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last bucket may go on in the next batch
            held = [c[cut:] for c in cols]
            if cut:
                yield emit([c[:cut] for c in cols])
        if len(held[0]):
            yield emit(held)

    if not large.head(1):
        return dealt.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "a long, b long")
    small = dealt.join(large, "key", "left_anti").select("key", "fp", "node")
    found = small.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "a long, b long")
    one_bit = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    half = dealt.join(large, "key", "left_semi").select("fp", "node").distinct().select("node", F.explode(F.concat(F.array("fp"), one_bit)).alias("half"))
    met = half.groupBy("half").agg(F.collect_set("node").alias("all")).where("size(all) > 1")  # at most 65 nodes are within one bit of a value
    return found.union(met.select(F.explode("all").alias("a"), F.array_min("all").alias("b")).where("a <> b").distinct())


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links)."""
    fps = written(fingerprints(docs, shingle), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    comps = components(links(nodes, bucket))
    classes = written(nodes.join(comps, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")), "classes")
    drop_written(nodes)
    return fps.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def shingles(text: str | None, shingle: int = NEAR_SHINGLE) -> np.ndarray:
    """The set of the text's shingles, as ascending hashes."""
    words = word_hashes((text or "").encode().lower())
    return np.unique(run_hashes(words, np.arange(max(1, len(words) - shingle + 1)), min(shingle, len(words)))) if len(words) else words


def sketch(text: str | None, shingle: int = NEAR_SHINGLE) -> tuple[bytes, int, bytes, list[int]]:
    """(digest of the set, distinct shingles, wide fingerprint, keys of the buckets). No words: zero bits, one key pattern of its own."""
    grams = shingles(text, shingle)
    ones, least = np.zeros(WIDTH, np.int64), np.full(WIDTH // 32, 0xFFFFFFFF, np.uint32)
    salts = np.arange(1, WIDTH // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(grams), 64 * 255):
        x = mix(grams[at : at + 64 * 255, None] + salts)
        least = np.minimum(least, x.view(np.uint32).min(axis=0))
        for b in range(0, len(x), 255):  # sums of 255 bits fit in a byte
            ones += np.unpackbits(x[b : b + 255].view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = mix(key * np.uint64(0xD1342543DE82EF95) + least[r : r + BANDS * ROWS : ROWS].astype(np.uint64))
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest(), len(grams), np.packbits(2 * ones > len(grams)).tobytes(), key.astype(np.int64).tolist()


def sketches(rows: DataFrame, shingle: int = NEAR_SHINGLE) -> DataFrame:
    """(row, doc_id, digest, n, wide, keys) of every whole text. rows: row, doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                digest, n, wide, keys = zip(*map(lambda t: sketch(t, shingle), b.column(2).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digest, pa.binary()), pa.array(n, pa.int64()), pa.array(wide, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["row", "doc_id", "digest", "n", "wide", "keys"])

    return rows.select("row", "doc_id", "text").mapInArrow(run, "row long, doc_id long, digest binary, n long, wide binary, keys array<long>")


def alike(one: np.ndarray, n: int | np.ndarray, many: np.ndarray, ns: np.ndarray) -> np.ndarray:
    """Which of many fingerprints (rows of 64-bit words, ns shingles) may be near copies of one."""
    most = np.maximum(ns, n)
    near = np.bitwise_count(many ^ one).sum(axis=1, dtype=np.int64) <= np.where(most > 5, LIMIT, TINY)
    return near & (np.minimum(ns, n) >= SIMILARITY * most)


def same_text(a: bytes, b: bytes) -> bool:
    """Whether two sets of shingles (ascending 64-bit hashes) are as similar as ``SIMILARITY``."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= SIMILARITY * (len(x) + len(y) - both)


def ball_links(fp: np.ndarray, n: np.ndarray, grams: list[bytes] | None = None) -> np.ndarray:
    """For each row of one bucket the first row of its component; with ``grams`` links are verified by the sets."""
    label = np.arange(len(fp))
    if len(fp) == 2:
        return np.array([0, 0 if alike(fp[0], n[0], fp[1:], n[1:])[0] and (grams is None or same_text(*grams)) else 1])
    refs = fp[np.linspace(0, len(fp) - 1, min(PIVOTS, len(fp))).astype(int)] if len(fp) > 64 else fp[:0]
    table = np.stack([np.bitwise_count(fp ^ r).sum(axis=1, dtype=np.int16) for r in refs]) if len(refs) else np.empty((0, len(fp)), np.int16)
    for i in range(len(fp) - 1):
        at = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        for d in table:
            if not len(at):
                break
            at = at[np.abs(d[at] - d[i]) <= TINY]
        at = at[alike(fp[i], n[i], fp[at], n[at])]
        if grams is None:
            at = at[np.unique(label[at], return_index=True)[1]]
        for j in at.tolist():
            a, b = sorted((int(label[i]), int(label[j])))
            if a != b and (grams is None or same_text(grams[i], grams[j])):
                label[label == b] = a
    return label


def _block_links(rows: DataFrame, by: list[str]) -> DataFrame:
    """Links (a, b) as stars within each group of ``by``; a group has a bounded number of rows."""
    exact = "grams" in rows.columns
    rows = rows.select(F.xxhash64(*by).alias("g"), "node", "n", "wide", *["grams"] * exact)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def emit(t: pa.Table) -> pa.RecordBatch:
            g, node, n = (t.column(c).to_numpy() for c in ("g", "node", "n"))
            fp = np.frombuffer(b"".join(t.column("wide").to_pylist()), np.uint64).reshape(len(g), -1)
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            edge = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1], [True])))
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if hi - lo > 1:
                    label = ball_links(fp[lo:hi], n[lo:hi], t.column("grams").slice(lo, hi - lo).to_pylist() if exact else None)
                    at = np.flatnonzero(label != np.arange(hi - lo))
                    a.append(node[lo + at])
                    b.append(node[lo + label[at]])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (a, b)], names=["a", "b"])

        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if not len(held):
                continue
            g = held.column("g").to_numpy()
            cut = int(np.searchsorted(g, g[-1]))  # the last group may go on in the next batch
            if cut:
                yield emit(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and len(held):
            yield emit(held)

    return rows.repartition("g").sortWithinPartitions("g", "node").mapInArrow(run, "a long, b long")


def near_links(nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between nodes (node, n, wide, keys) with the components of all likely near copies that share a bucket."""
    return _dealt_links(nodes.select(F.explode("keys").alias("key"), "node", "n", "wide"), F.lit(1), bucket)


def exact_links(rows: DataFrame, linked: DataFrame, shingle: int = NEAR_SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links whose components are those of all near copies within each component of ``linked`` (node, component, n, wide)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                grams = pa.array([shingles(t, shingle).tobytes() for t in b.column(4).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*b.columns[:4], grams], names=["key", "node", "n", "wide", "grams"])

    texts = linked.join(rows.select(F.col("row").alias("node"), "text"), "node").select(F.col("component").alias("key"), "node", "n", "wide", "text")
    dealt = written(texts.mapInArrow(run, "key long, node long, n long, wide binary, grams binary"), "shingles")
    return _dealt_links(dealt, F.col("n"), bucket * SET)


def _dealt_links(dealt: DataFrame, weight: Column, bucket: int) -> DataFrame:
    """Links (a, b) within each key. dealt: key, node, n, wide; with grams, links are verified by these sets.

    A key whose nodes weigh more than ``bucket`` is not compared by one task: its first node
    links all its near copies at once, and only what is left meets all its nodes, in
    blocks of at most about ``bucket``.
    """
    exact = ["grams"] * ("grams" in dealt.columns)
    dealt = dealt.withColumn("weight", weight.cast("long"))
    large = written(dealt.groupBy("key").agg(F.sum("weight").alias("rows")).where(F.col("rows") > bucket), "large")
    if not large.head(1):
        return _block_links(dealt, ["key"])
    small = _block_links(dealt.join(large, "key", "left_anti"), ["key"])
    hot = dealt.join(large, "key")
    first = written(hot.groupBy("key").agg(F.min(F.struct("node", "n", "wide", *exact)).alias("first")), "first")

    def meets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                one, fp = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint64).reshape(part.num_rows, -1) for c in ("first_wide", "wide"))
                a, b = (part.column(c).to_numpy(zero_copy_only=False) for c in ("first_n", "n"))
                near = alike(one, a, fp, b)
                if exact:
                    x, y = part.column("first_grams"), part.column("grams")
                    near[[i for i in np.flatnonzero(near).tolist() if not same_text(x[i].as_py(), y[i].as_py())]] = False
                names = [c for c in part.schema.names if not c.startswith("first_") or c == "first_node"]
                yield part.select(names).append_column("near", pa.array(near))

    kept = ["key", "rows", "weight", "node", "n", "wide", *exact]
    flat = hot.join(first, "key").select(*kept, F.col("first.node").alias("first_node"), *(F.col(f"first.{c}").alias(f"first_{c}") for c in ("n", "wide", *exact)))
    met = written(flat.mapInArrow(meets, "key long, rows long, weight long, node long, n long, wide binary, " + "grams binary, " * len(exact) + "first_node long, near boolean"), "met")
    stars = met.where("near and node <> first_node").select(F.col("node").alias("a"), F.col("first_node").alias("b"))
    half = max(1, bucket // 2)
    left = written(met.where("not near").groupBy("key").agg(F.sum("weight").alias("left")), "left")
    blocks = met.join(left, "key").select("key", "node", "n", "wide", *exact, "near", F.ceil(F.col("rows") / half).cast("int").alias("k"), F.ceil(F.col("left") / half).cast("int").alias("m"))
    at = F.xxhash64("node", F.lit("block"))
    every = blocks.withColumn("x", F.pmod(at, F.col("k")).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    rest = blocks.where("not near").withColumn("y", F.pmod(at, F.col("m")).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return small.union(stars).union(_block_links(every.unionByName(rest).select("key", "x", "y", "node", "n", "wide", *exact), ["key", "x", "y"]))


def near_classes(rows: DataFrame, shingle: int = NEAR_SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """(row, doc_id, component): the smallest row that near copies reach. rows: row (a number of its own), doc_id, text."""
    every = written(sketches(rows, shingle), "sketches")
    nodes = written(every.groupBy("digest", "n", "wide").agg(F.min("row").alias("node"), F.min("keys").alias("keys")), "nodes")
    linked = nodes.select("node", "n", "wide").join(components(near_links(nodes, bucket)), "node")
    comps = components(exact_links(rows, linked, shingle, bucket))
    classes = written(nodes.select("digest", "node").join(comps, "node", "left").select("digest", F.coalesce("component", "node").alias("component")), "classes")
    return every.join(classes, "digest").select("row", "doc_id", "component")


def numbered(docs: DataFrame) -> DataFrame:
    """(row, doc): the rows with a number of their own: the doc_id, or a written number if ids are null or repeat."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").head(1):
        return written(rows.select(F.monotonically_increasing_id().alias("row"), "doc"), "rows")
    return rows.select(F.col("doc.doc_id").alias("row"), "doc")


def similar_documents(docs: DataFrame, shingle: int = NEAR_SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """doc_id, component_id (smallest doc_id reachable by near copies) of every row with an id."""
    rows = numbered(docs.where("doc_id is not null").select("doc_id", "text")).select("row", "doc.doc_id", "doc.text")
    classes = near_classes(rows, shingle, bucket)
    least = classes.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return classes.join(least, "component").select("doc_id", "component_id")


def first_of_each(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows but those whose class (doc_id, component_id) has a smaller doc_id; rows without id stay."""
    later = classes.where("doc_id <> component_id").select("doc_id")
    return docs.join(later, "doc_id", "left_anti").select(docs.columns)


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component of near copies, repeated rows and rows without id included: the smallest doc_id, null last."""
    rows = numbered(docs)
    classes = near_classes(rows.select("row", "doc.doc_id", "doc.text"))
    order = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row")
    kept = classes.groupBy("component").agg(F.min(order).alias("one")).select("one.row")
    return rows.join(kept, "row", "left_semi").select("doc.*")
