"""SimHash near-duplicates by Golay-code fuzzy hashing.

Method: a document's 64-bit fingerprint is the bitwise majority of the XXH64 hashes of its 3-word shingles.
Equal fingerprints form one class each. The 64 bits are cut into segments of 22, 21 and 21 bits. Two
fingerprints that differ in at most two bits have, by pigeonhole, an equal segment i and a following one (in
cyclic order) that differs in at most one bit. A segment, padded to 23 bits, is a word of the perfect
binary Golay code [23, 12, 7]: words that differ in up to two bits lie within four bits of a common codeword,
and a word has at most six codewords that near. So each fingerprint gets the keys (i, segment i, index of
a codeword near the next segment), at most 18; fingerprints that share a key are compared exactly.

A key that more than ``PAIR_LIMIT`` fingerprints share emits no pairs. Its fingerprints are linked through
the words within one bit of each (65): two fingerprints at a distance of at most two share such a word. Each
word links its fingerprints to the smallest one, so work and links are linear in the group and no link is lost.

Links become components by alternating star contractions (each node takes the smallest neighbour), which
shuffle links by node and settle every round in the shared folder.

``first_of_groups`` is the filter for corpora: its links are similarities of 0.8 and more of 5-word shingles, with
candidates from fingerprints of samples that are decoded to Golay codewords in the same way.

Defined results: no words (null or empty text) give fingerprint 0, which links like any other; null ids keep
their fingerprint and take the smallest id of their component (null if it has none); repeated rows repeat;
empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import ngrams, settle, slices, small_batches, texts, word_hashes, word_spans

SHINGLE = 3
MAX_BITS = 2
#: Fingerprints of one key up to which all pairs are compared; beyond, stars of one-bit words link them.
PAIR_LIMIT = 24
#: Ids up to which a list of them is broadcast (about 16 bytes each).
BROADCAST_IDS = 2_000_000
#: Fingerprints of samples for a similarity of whole texts, and shingles a sample.
SAMPLES, SAMPLE = 24, 5
#: Bytes of sets of a block of classes that meet another block in one task.
CELL_BYTES = 4 << 20
#: Bits of a set's mark, which rules out pairs before their sets are compared.
MARK_BITS = 128
_SLICE = 1 << 20
#: Widths of the three segments and the generator polynomial of the Golay code (fixed values).
SEGMENTS = (22, 21, 21)
GENERATOR = 0b101011100011


def shingle_hashes(text: bytes, n: int = SHINGLE) -> list[int]:
    """Unsigned XXH64 (seed 42) of the shingles of a text, with A-Z lower-cased."""
    w = text.lower().split()
    if not w:
        return []
    h = xxhash.xxh64_intdigest
    if len(w) < n:
        return [h(b" ".join(w), 42)]
    return [h(x, 42) for x in map(b" ".join, zip(*(w[i:] for i in range(n)), strict=False))]


def fingerprints(batch: list[bytes]) -> np.ndarray:
    """The fingerprint of each text as a signed 64-bit integer."""
    out = np.zeros(len(batch), np.uint64)
    for a, b in slices([len(t) for t in batch], _SLICE):
        hashes = [np.array(shingle_hashes(t), np.uint64) for t in batch[a:b]]
        for i, h in enumerate(hashes, a):
            if len(h):
                ones = np.zeros(64, np.int64)
                for at in range(0, len(h), 1 << 14):
                    bits = np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    ones += bits.sum(axis=0, dtype=np.int32)
                out[i] = np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0]
    return out.view(np.int64)


def simhash(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long) of each row."""
    rows = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints(texts(b, "text")))], ["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {kind}, fp bigint")


@cache
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low and the high half of a word, and per syndrome the error patterns to the codewords
    within four bits (six columns, the nearest first) with their number."""

    def syndrome(v: int) -> int:
        for i in range(22, 10, -1):
            if v >> i & 1:
                v ^= GENERATOR << (i - 11)
        return v

    one = np.array([syndrome(1 << i) for i in range(23)], np.int64)
    halves = []
    for shift, width in ((0, 12), (12, 11)):
        t = np.zeros(1 << width, np.int64)
        for i in range(width):
            t[1 << i : 2 << i] = t[: 1 << i] ^ one[shift + i]
        halves.append(t)
    errors, count = np.zeros((2048, 6), np.int64), np.zeros(2048, np.int64)
    for weight in range(5):
        for places in combinations(range(23), weight):
            s, v = 0, 0
            for p in places:
                s ^= int(one[p])
                v |= 1 << p
            errors[s, count[s]] = v
            count[s] += 1
    return halves[0], halves[1], errors, count


def codeword_indices(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (12 message bits) of the codewords within four bits of each 23-bit word: positions, indices."""
    low, high, errors, count = golay_tables()
    s = low[segment & 0xFFF] ^ high[segment >> 12]
    at = np.repeat(np.arange(len(segment)), count[s])
    nth = np.arange(len(at)) - np.repeat(np.cumsum(count[s]) - count[s], count[s])
    return at, (segment[at] ^ errors[s[at], nth]) >> 11


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, keys) of all keys of each fingerprint; a key packs segment number, segment and index."""
    u = fp.view(np.uint64)
    seg, shift = [], 0
    for width in SEGMENTS:
        seg.append(((u >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64))
        shift += width
    places, keys = [], []
    for i in range(3):
        at, index = codeword_indices(seg[(i + 1) % 3])
        places.append(at)
        keys.append((np.int64(i) << 40) | (seg[i][at] << 12) | index)
    return np.concatenate(places), np.concatenate(keys)


def keyed(fps: DataFrame) -> DataFrame:
    """(key, fp) for all keys of the distinct fingerprints ``fps``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at, key = golay_keys(fp)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[at])], ["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key bigint, fp bigint")


def links(fps: DataFrame, *, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Links (a, b), a < b, at ``MAX_BITS`` or fewer differing bits, that connect all distinct fingerprints
    that such links connect."""
    keys = settle(keyed(fps))
    size = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = settle(keys.join(size, "key"))
    small = members.where(F.col("n") <= pair_limit).groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("m"))
    # Groups of at most pair_limit: the pairs are made inside the row.
    pairs = small.select(F.explode("m").alias("a"), "m").select("a", F.explode(F.filter("m", lambda x: (x > F.col("a")) & (F.bit_count(x.bitwiseXOR(F.col("a"))) <= MAX_BITS))).alias("b"))
    large = members.where(F.col("n") > pair_limit).select("fp").distinct()
    masks = F.lit([0, *(1 << i for i in range(63)), -(1 << 63)]).cast("array<bigint>")
    near_words = large.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("word"))
    least = near_words.groupBy("word").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("word", "a")
    stars = near_words.join(least, "word").where("a < fp").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS).distinct()


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star contraction of links (a, b), a < b."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # Large star: the larger neighbours of each node go to its smallest neighbour (m <= u < v).
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    # Small star: the smaller neighbours of each node, and the node, go to the smallest of them.
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b")
    return moved.unionByName(low.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node that has a link (links as (a, b), a < b).

    Large-star and small-star contractions until the links stay the same. Minima are aggregated before they
    meet the links; links are settled every round, and counted and hashed while they are written."""
    edges, last = _observed(edges)
    while last[0]:
        edges, now = _observed(_stars(edges))
        if now == last:
            break
        last = now
    root = edges.groupBy("b").agg(F.min("a").alias("root")).select(F.col("b").alias("node"), "root")
    return root.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _observed(edges: DataFrame) -> tuple[DataFrame, tuple]:
    seen = Observation()
    out = settle(edges.observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.shiftright(F.xxhash64("b", "a"), 24)).alias("s")))
    return out, tuple(seen.get[k] for k in ("n", "x", "s"))


def _component_table(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(c_fp, root, component_id) for classes (fp, least) and links (a, b) of them: the component of every class."""
    found = settle(components(pairs))
    rooted = classes.join(found, classes["fp"] == found["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    roots = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(roots, "root").select(F.col("fp").alias("c_fp"), "root", "component_id")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest id of the component) per row."""
    prints = settle(simhash(docs, id_col=id_col, text_col=text_col))
    classes = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    answer = _component_table(classes, links(classes))
    return prints.join(answer, F.col("fp") == F.col("c_fp")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_sets(batch: list[bytes], n: int) -> list[np.ndarray]:
    """Distinct 64-bit hashes of each text's n-word shingles (fewer words: of the whole sequence), A-Z lower-cased."""
    buf = np.frombuffer(b" ".join([*batch, b""]).lower(), np.uint8)
    start, end = word_spans(buf)
    h, first = word_hashes(buf, start, end), np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in batch)]))
    return [np.unique(ngrams(h[a:b], min(n, b - a))) if b > a else np.zeros(0, np.uint64) for a, b in zip(first, first[1:], strict=False)]


@cache
def _mixers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(23)
    top = np.iinfo(np.uint64).max
    return rng.integers(0, top, SAMPLES * SAMPLE, np.uint64), rng.integers(0, top, SAMPLES * SAMPLE, np.uint64) | np.uint64(1)


def sample_keys(sets: list[np.ndarray]) -> np.ndarray:
    """``SAMPLES`` keys of each set: the SimHash of ``SAMPLE`` shingles, each the least of the set in its own order, with
    the three segments decoded to their nearest codewords."""
    a, b = _mixers()
    chosen = np.zeros((len(sets), SAMPLES * SAMPLE), np.uint64)
    with np.errstate(over="ignore"):
        for i, s in enumerate(sets):
            least = np.full(len(a), np.iinfo(np.uint64).max)
            for at in range(0, len(s), 1024):
                part = s[at : at + 1024]
                mixed = (part[:, None] ^ a) * b
                mixed ^= mixed >> np.uint64(29)
                top = mixed.argmin(axis=0)
                value = mixed[top, np.arange(len(a))]
                better = value <= least
                chosen[i, better], least[better] = part[top[better]], value[better]
    bits = np.unpackbits(chosen.view(np.uint8).reshape(len(sets), SAMPLES, SAMPLE, 8), axis=3, bitorder="little").sum(axis=2, dtype=np.uint8) * 2 > SAMPLE
    fp = np.packbits(bits, axis=2, bitorder="little").reshape(len(sets), SAMPLES * 8).view(np.uint64)
    low, high, errors, _ = golay_tables()
    keys, shift = np.repeat(np.arange(SAMPLES, dtype=np.int64)[None, :], len(sets), axis=0), 0
    for width in SEGMENTS:
        seg = ((fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
        keys = (keys << 12) | ((seg ^ errors[low[seg & 0xFFF] ^ high[seg >> 12], 0]) >> 11)
        shift += width
    return keys


def parity_marks(sets: list[np.ndarray]) -> np.ndarray:
    """Size and ``MARK_BITS`` parities of each set, as signed 64-bit integers: a shingle flips one bit, so two marks differ in at
    most as many bits as the sets differ in shingles."""
    out = np.zeros((len(sets), 1 + MARK_BITS // 64), np.int64)
    with np.errstate(over="ignore"):
        for i, s in enumerate(sets):
            at = (s * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(MARK_BITS)
            odd = (np.bincount(at.astype(np.int64), minlength=MARK_BITS) & 1).astype(np.uint8)
            out[i, 0], out[i, 1:] = len(s), np.packbits(odd, bitorder="little").view(np.int64)
    return out


def _close(x: Column, y: Column, similarity: float) -> Column:
    """Whether the marks allow a Jaccard similarity of ``similarity``: sets that have it differ in at most
    (1 - similarity) / (1 + similarity) of the sum of their sizes."""
    bits = sum((F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(2, 1 + MARK_BITS // 64)), F.bit_count(x[1].bitwiseXOR(y[1])))
    return F.greatest(bits, F.abs(x[0] - y[0])) <= (x[0] + y[0]) * F.lit((1 - similarity) / (1 + similarity)) + 1e-6


def set_class(s: np.ndarray) -> int:
    """A signed 64-bit hash of a set of shingles; the empty set has 0."""
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), 42)).view(np.int64)) if len(s) else 0


def sampled(docs: DataFrame, *, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """doc_id, fp (the class of documents with equal sets of shingles), ``keys`` and ``mark`` of each row."""
    rows = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            batch, fps, keys, marks = texts(b, "text"), [], [], []
            for i, j in slices([len(t) for t in batch], _SLICE):
                sets = shingle_sets(batch[i:j], shingle)
                fps += map(set_class, sets)
                keys += [k if len(s) else k[:0] for s, k in zip(sets, sample_keys(sets), strict=True)]
                marks += list(parity_marks(sets))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.list_(pa.int64()))], ["doc_id", "fp", "keys", "mark"])

    return rows.mapInArrow(run, f"doc_id {kind}, fp bigint, keys array<bigint>, mark array<bigint>")


def _shared(classes: DataFrame) -> DataFrame:
    """(key, fp, n) of the keys that several classes (fp, keys) have; n is their number. Keys are shuffled once."""
    members = classes.select("fp", F.explode("keys").alias("key")).repartition("key")
    size = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return members.join(size, "key")


def _led(shared: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """(key, fp, a, size, close) of rows (key, fp, n): ``a`` leads the key. It is the class whose keys are the most common, as the
    text that copies were made from shares keys with all of them. ``close``: the marks of fp and a allow the pair."""
    weight = shared.groupBy("fp").agg(F.sum("n").alias("w"))
    rows = shared.join(weight.join(classes.select("fp", "mark"), "fp"), "fp").select("key", "fp", "w", "mark")
    lead = rows.groupBy("key").agg(F.min_by(F.struct("fp", "mark"), F.struct(-F.col("w"), F.xxhash64("fp"), "fp")).alias("l"))
    return rows.join(lead, "key").select("key", "fp", F.col("l.fp").alias("a"), F.col("mark")[0].alias("size"), _close(F.col("mark"), F.col("l.mark"), similarity).alias("close"))


def _class_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(fp, s): the sets of the classes ``wanted`` (fp), each cut again from the document with its smallest id."""
    ids = settle(classes.join(wanted, "fp").select(F.col("least").alias("__k"), "fp"))
    small = ids.count() <= BROADCAST_IDS
    rows = docs.join(F.broadcast(ids) if small else ids, F.col(id_col).eqNullSafe(F.col("__k"))).select("fp", F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            batch, wanted = texts(b, "text"), b.column(0).to_pylist()
            for i, j in slices([len(t) for t in batch], _SLICE):
                found = [(fp, s.view(np.int64)) for fp, s in zip(wanted[i:j], shingle_sets(batch[i:j], shingle), strict=True) if set_class(s) == fp]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.list_(pa.int64()))], ["fp", "s"])

    return rows.mapInArrow(run, "fp bigint, s array<bigint>").dropDuplicates(["fp"])


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets (fp, s) are similar."""
    side = lambda c: sets.select(F.col("fp").alias(c), F.col("s").alias(f"s_{c}"))
    both = F.size(F.array_intersect("s_a", "s_b"))
    return pairs.join(side("b"), "b").join(side("a"), "a").where(both >= F.lit(similarity) * (F.size("s_a") + F.size("s_b") - both)).select("a", "b")


def _cells(rows: DataFrame, cell_bytes: int) -> DataFrame:
    """(cell, fp, root) of rows (key, fp, size, root), so that any two classes of one key and of different roots meet in a cell.

    A key's root of the most bytes is its main one. It and the others are cut by hashes into blocks of about ``cell_bytes``;
    each block of the others meets each block of the main root and each of the others. Keys of one root have no cell. So a
    key's work is linear while its others fit in one block, and no cell holds more than about two blocks."""
    part = rows.groupBy("key", "root").agg(F.sum(F.col("size") * 8).alias("b"))
    parts = part.groupBy("key").agg(F.max_by("root", F.struct("b", "root")).alias("main"), F.max("b").alias("main_b"), F.sum("b").alias("b"), F.count("*").alias("roots")).where("roots > 1")
    blocks = lambda b: F.ceil(b / F.lit(cell_bytes)).cast("int")
    parts = parts.select(F.col("key").alias("k"), "main", blocks(F.col("main_b")).alias("mains"), blocks(F.col("b") - F.col("main_b")).alias("others"))
    main = F.col("root") == F.col("main")
    at = F.pmod(F.xxhash64("fp"), F.when(main, F.col("mains")).otherwise(F.col("others"))).cast("int")
    placed = rows.join(parts, F.col("key") == F.col("k")).withColumns({"is_main": main, "at": at})
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda kind, i, j: F.xxhash64("key", F.lit(kind), i, j)
    to_mains = F.transform(upto("mains"), lambda x: cell(0, F.col("at"), x))
    to_others = F.transform(F.filter(upto("others"), lambda x: x != F.col("at")), lambda x: cell(1, F.least(F.col("at"), x), F.greatest(F.col("at"), x)))
    of_main = F.transform(upto("others"), lambda x: cell(0, x, F.col("at")))
    return placed.select("fp", "root", F.explode(F.when(F.col("is_main"), of_main).otherwise(F.concat(to_mains, to_others))).alias("cell"))


def cell_links(sets: list[np.ndarray], roots: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links (positions) at ``similarity`` or more that connect what all such links of sets of different roots connect.

    Shared shingles are counted with all sets at once, through the sets that hold each shingle. Sets of the most common
    root do not count, as the other end of their links does."""
    size = np.array([len(s) for s in sets], np.int64)
    _, which, holders = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size)[np.argsort(which, kind="stable")]
    first, offset = np.cumsum(holders) - holders, np.r_[0, np.cumsum(size)]
    _, label = np.unique(roots, return_inverse=True)
    out = []
    for i in np.flatnonzero(label != np.bincount(label).argmax()):
        held = which[offset[i] : offset[i + 1]]
        held = held[holders[held] > 1]
        n = holders[held]
        both = np.bincount(owner[np.repeat(first[held] - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(sets))
        near = np.flatnonzero((both >= similarity * (size[i] + size - both)) & (label != label[i]))
        if len(near):
            met, at = np.unique(label[near], return_index=True)
            out += [(int(i), int(j)) for j in near[at]]
            label[np.isin(label, met)] = label[i]
    return out


def similar_links(docs: DataFrame, classes: DataFrame, *, id_col: str, text_col: str, shingle: int, similarity: float, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """Links (a, b) of classes (fp, least, keys, mark), all with a Jaccard similarity of ``similarity`` or more, that connect
    what all such links of classes with a key in common connect.

    First each class meets the leader of each of its keys. Those links become components. Then the other classes of a key
    that still are in different components meet each other, whatever the key's size: in cells of a bounded size, on their
    whole sets (``_cells``). A cell gives a forest, at most one link less than it has classes, so no key gives rows by pairs."""
    led = settle(_led(settle(_shared(classes)), classes, similarity))
    sets = settle(_class_sets(docs, classes, led.select("fp").distinct(), id_col, text_col, shingle))
    close = led.where("fp <> a and close").select(F.least("a", "fp").alias("a"), F.greatest("a", "fp").alias("b")).distinct()
    verified = settle(_verified(close, sets, similarity))
    rest = led.where("fp <> a").select("key", "fp", "size")
    rooted = settle(rest.join(components(verified), F.col("fp") == F.col("node"), "left").select("key", "fp", "size", F.coalesce("root", "fp").alias("root")))

    def run(t: pa.Table) -> pa.Table:
        fp, s = t.column("fp").to_numpy(), t.column("s").combine_chunks()
        at, values = s.offsets.to_numpy(), s.values.to_numpy()
        found = cell_links([values[i:j] for i, j in zip(at, at[1:], strict=False)], t.column("root").to_numpy(), similarity)
        ends = np.sort(fp[np.array(found, np.int64).reshape(-1, 2)], axis=1)
        return pa.table({"a": ends[:, 0], "b": ends[:, 1]})

    met = _cells(rooted, cell_bytes).join(sets, "fp").groupBy("cell").applyInArrow(run, "a bigint, b bigint")
    return verified.unionByName(met).distinct()


def first_of_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group of documents that links of a ``similarity`` (Jaccard
    similarity of the sets of ``shingle``-word shingles) or more connect, the row with the smallest id stays.

    One 64-bit fingerprint of a whole text differs in about ten bits at a similarity of 0.8, far more than short keys
    can bridge. So candidates come from ``SAMPLES`` fingerprints of ``SAMPLE`` sampled shingles each: at 0.8 two documents
    share all samples of a fingerprint with odds of 0.33, and none of 24 with odds of 7e-5.

    Documents without words are alike. Rows that share an id and a set of shingles count once, those that share an id
    alone are documents of their own; of equal ids the smaller class stays; null ids stand last. Only ids meet the texts: up to
    ``BROADCAST_IDS`` are broadcast, more are joined by a shuffle."""
    rows = settle(sampled(docs, id_col=id_col, text_col=text_col, shingle=shingle))
    classes = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.max("keys").alias("keys"), F.max("mark").alias("mark")))
    named = classes.select("fp", "least")
    found = similar_links(docs, classes, id_col=id_col, text_col=text_col, shingle=shingle, similarity=similarity)
    answer = settle(_component_table(named, settle(found)).join(named, F.col("c_fp") == F.col("fp")).select("fp", "root", "least"))
    # The first class of each group: smallest id, nulls last, then smallest class.
    first = answer.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("n"), "least", "fp")).alias("x")).select(F.col("x.least").alias("doc_id"), "x.fp")
    kept = settle(first)
    ids = rows.groupBy("doc_id").agg(F.count("*").alias("n"))
    twice = settle(ids.where("n > 1 or doc_id is null").select(F.col("doc_id").alias("__k")))
    gone = settle(rows.select("doc_id").join(kept.select("doc_id"), "doc_id", "left_anti").where("doc_id is not null").select(F.col("doc_id").alias("__k")).unionByName(twice).distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    single = docs.join(gone, F.col(id_col).eqNullSafe(F.col("__k")), "left_anti")
    if not twice.limit(1).count():
        return single

    @F.pandas_udf("bigint")
    def class_of(s: pd.Series) -> pd.Series:
        return pd.Series([set_class(x) for t in s for x in shingle_sets([(t or "").encode("utf-8", "replace")], shingle)], dtype="int64")

    again = docs.join(twice, F.col(id_col).eqNullSafe(F.col("__k")), "left_semi").withColumn("__fp", class_of(F.col(text_col)))
    winners = kept.select(F.col("doc_id").alias("__k"), F.col("fp").alias("__f"))
    again = again.join(winners, F.col(id_col).eqNullSafe(F.col("__k")) & (F.col("__fp") == F.col("__f")), "left_semi").dropDuplicates([id_col, "__fp"])
    return single.unionByName(again.select(*docs.columns))
