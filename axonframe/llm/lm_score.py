"""LM scoring: prediction by partial matching over a trie of byte contexts.

Method: the pretrained model counts every byte of the lower-cased (A-Z) training texts, and an end mark, in
its context of ``ORDER`` bytes. Shorter contexts are suffixes and count a byte once for each longer context
that has it (update exclusion). A byte is coded at the longest known context that has it, with probability in
proportion to its count less one half; otherwise the context escapes to the next shorter one, where the
symbols of the longer one are excluded. The odds of an escape are estimated per context length by leaving out
one occurrence at a time: how often a context with so many occurrences and symbols meets a new symbol, over
the whole model, so that its blocks change no probability. Below the empty context all other byte values are
equally likely. ``score`` is the log10 probability of the text.

Scale: counts of all training texts are summed per task and then by a shuffle; the model grows with the
corpus and is never sampled. For scoring it is cut into blocks by the last two context bytes (all longer
contexts of a position share its block), each of at most about ``BLOCK_ROWS`` rows, so a block has a proven
bound; blocks are broadcast one by one and every task scores a position in the one block it belongs to. A task
deals the positions of ``_HELD`` bytes of texts to the blocks and then reads each block once. Word counts for
the base score are cut into blocks by hash in the same way.

Words are compared by 64-bit hashes (odds of 2**-64 a pair of words that two are taken for one).

Defined results: null text is empty: one token, the end. Very long texts are scored whole, in pieces of
bounded memory. With nothing to train on every byte has probability 1/256. Rows are independent, so ties,
repeated rows, null ids, empty tables and extra columns need no care.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, settle, slices, small_batches, texts, word_hashes, word_spans

ORDER = 5
#: Model rows per block that is collected and broadcast (16 bytes a row).
BLOCK_ROWS = 3_000_000
_SLICE = 1 << 19
_BUFFER = 4_000_000
#: Bytes of texts that a task scores against all blocks at once (about 12 bytes of memory each).
_HELD = 2 << 20
_PAD, _END = 0xFE, 0xFF  # bytes that UTF-8 never uses
WORD, GRAM, END = 0, 1, 2


@dataclass
class Flat:
    """Several texts in one buffer: pads, text, end mark each; ``doc`` numbers the texts."""

    buf: np.ndarray
    starts: np.ndarray  # of each text's first byte
    doc: np.ndarray  # number of the text of each byte, -1 for pads


def flatten(batch: list[bytes]) -> Flat:
    pad, end = bytes([_PAD]) * ORDER, bytes([_END])
    buf = np.frombuffer(b"".join([x for t in batch for x in (pad, t.lower(), end)]), np.uint8)
    n = np.array([len(t) + 1 for t in batch], np.int64)
    starts = np.cumsum(n + ORDER) - n
    doc = np.repeat(np.arange(len(batch), dtype=np.int32), n + ORDER)
    for k in range(1, ORDER + 1):
        doc[starts - k] = -1
    return Flat(buf, starts, doc)


def grams(flat: Flat) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, key) of all coded bytes in pieces; a key packs context and byte, the byte lowest."""
    for a in range(ORDER, len(flat.buf), _SLICE):
        b = min(len(flat.buf), a + _SLICE)
        key = np.zeros(b - a, np.uint64)
        for k in range(ORDER, -1, -1):
            key = (key << np.uint64(8)) | flat.buf[a - k : b - k]
        ok = flat.doc[a:b] >= 0
        yield flat.doc[a:b][ok], key[ok]


def tokens(flat: Flat) -> tuple[np.ndarray, np.ndarray]:
    """(text number, word hash) of all words. Pads and end marks are turned to spaces first."""
    buf = np.where(flat.buf >= _PAD, np.uint8(32), flat.buf)
    start, end = word_spans(buf)
    return np.searchsorted(flat.starts, start, "right") - 1, word_hashes(buf, start, end)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = _firsts(keys)
    return keys[first], np.diff(np.append(first, len(keys)))


def count_model(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """(kind, key, n): counts of words, of full-order grams and of ends over all rows."""
    rows = small_batches(docs).select(F.col(text_col).alias("text"))

    def emit(kind: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = _runs(np.concatenate(parts))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["kind", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, held = 0, {WORD: [], GRAM: []}
        for b in batches:
            all_texts = texts(b, "text")
            for i, j in slices([len(t) for t in all_texts], _SLICE):
                flat = flatten(all_texts[i:j])
                ends += j - i
                held[WORD].append(tokens(flat)[1])
                held[GRAM] += [k for _, k in grams(flat)]
                for kind, parts in held.items():
                    if sum(map(len, parts)) >= _BUFFER:
                        yield emit(kind, parts)
                        parts.clear()
        for kind, parts in held.items():
            if parts:
                yield emit(kind, parts)
        yield pa.RecordBatch.from_arrays([pa.array([END], pa.int32()), pa.array([0], pa.int64()), pa.array([ends], pa.int64())], ["kind", "key", "n"])

    return rows.mapInArrow(run, "kind int, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))


class Lookup:
    """Values by 64-bit key: keys sorted by a bijective mix, a directory over its top bits, and short scans."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        mixed = mix64(keys)
        order = np.argsort(mixed)
        self.mixed, self.values = mixed[order], values[order]
        self.bits = max(1, int(len(keys)).bit_length())
        edges = np.searchsorted(self.mixed >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64))
        self.start = edges.astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key among the values, -1 if absent."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.mixed) or not len(keys):
            return out
        h = mix64(keys)
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, stop = self.start[slot].astype(np.int64), self.start[slot + 1]
        which = np.flatnonzero(at < stop)
        at, stop, h = at[which], stop[which], h[which]
        while len(which):
            hit = self.mixed[at] == h
            out[which[hit]] = at[hit]
            at = at + 1
            go = ~hit & (at < stop)
            which, at, stop, h = which[go], at[go], stop[go], h[go]
        return out


@dataclass
class Level:
    """One context length: grams with the logs of their shares; contexts with their costs when a text starts
    coding there and when it has escaped from there to the next shorter length (with exclusion)."""

    grams: np.ndarray
    log_count: np.ndarray
    contexts: np.ndarray
    total: np.ndarray
    distinct: np.ndarray
    log_total: np.ndarray
    log_escape: np.ndarray
    log_total_below: np.ndarray
    log_escape_below: np.ndarray


def _position(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, -1)


def _firsts(sorted_values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))


def _class(x: np.ndarray) -> np.ndarray:
    """0 to 7 as they are, then two classes per doubling."""
    x = np.maximum(x, 0.0)
    return np.minimum(np.where(x < 8, x, 8 + np.floor(2 * np.log2(np.maximum(x, 8) / 8))), 63).astype(np.int64)


class Escapes:
    """Odds that a context with n occurrences of d symbols meets a new one, by leaving out one occurrence of the
    contexts given; a prior of weight 2 stands at d / 2n."""

    def __init__(self, n: np.ndarray, d: np.ndarray, once: np.ndarray) -> None:
        self.new, self.all = np.zeros((64, 64)), np.zeros((64, 64))
        left = _class(n - 1)
        np.add.at(self.new, (left, _class(d - 1)), once)
        np.add.at(self.all, (left, _class(d - 1)), once)
        np.add.at(self.all, (left, _class(d)), n - once)

    def add(self, other: Escapes) -> None:
        """Take in what other contexts of the same length have met."""
        self.new += other.new
        self.all += other.all

    def __call__(self, n: np.ndarray, d: np.ndarray) -> np.ndarray:
        at = _class(n), _class(d)
        return np.clip((self.new[at] + d / np.maximum(n, 1.0)) / (self.all[at] + 2), 1e-5, 0.9999)


def _totals(n: np.ndarray, d: np.ndarray, escape: np.ndarray) -> np.ndarray:
    """Log of what 2c - 1 is divided by: all halves less one a symbol, over the odds of no escape."""
    return np.log10(2 * n - d) - np.log10(1 - escape)


def _contexts(keys: np.ndarray, n: np.ndarray):
    """Contexts of sorted grams with their numbers of symbols, and a function that sums over each one's grams."""
    ctx = keys >> np.uint64(8)
    first = _firsts(ctx)
    sums = lambda x: np.add.reduceat(x.astype(np.float64), first) if len(first) else np.zeros(0)
    return ctx[first], np.diff(np.append(first, len(ctx))).astype(np.float64), sums


def tally(by_order: list[tuple[np.ndarray, np.ndarray]]) -> list[Escapes]:
    """Escapes of each order from (sorted grams, counts) of each."""
    out = []
    for keys, n in by_order:
        _, distinct, sums = _contexts(keys, n)
        out.append(Escapes(sums(n), distinct, sums(n == 1)))
    return out


def build_levels(by_order: list[tuple[np.ndarray, np.ndarray]], odds: list[Escapes] | None = None) -> list[Level]:
    """Levels 0 to ORDER from (sorted grams, counts) of each; ``odds`` are those of the whole model, if these are
    a part of it."""
    levels: list[Level] = []
    odds = odds or tally(by_order)
    for j, (keys, n) in enumerate(by_order):
        contexts, distinct, sums = _contexts(keys, n)
        total = sums(n)
        escape = odds[j](total, distinct)
        if j:
            mask = np.uint64((1 << 8 * j) - 1)
            lower, counts = by_order[j - 1]
            up = levels[-1]
            at = _position(up.contexts, contexts & (mask >> np.uint64(8)))
            rest, kinds = up.total[at] - sums(counts[_position(lower, keys & mask)]), up.distinct[at] - distinct
            none = kinds <= 0  # nothing is left there: the text goes on to the next shorter context for free
            rest, kinds = np.where(none, 1.0, rest), np.where(none, 1.0, kinds)
            e = odds[j - 1](rest, kinds)
            log_below, log_escape_below = np.where(none, 0.0, _totals(rest, kinds, e)), np.where(none, 0.0, np.log10(e))
        else:
            log_below, log_escape_below = np.log10(np.maximum(256 - distinct, 1.0)), np.zeros(len(distinct))
        levels.append(Level(keys, np.log10(2.0 * n - 1), contexts, total, distinct, _totals(total, distinct, escape), np.log10(escape), log_below, log_escape_below))
    return levels


@dataclass
class Block:
    """A bounded part of the model."""

    number: int
    blocks: int
    words: Lookup
    word_logs: np.ndarray = field(init=False)
    top: Lookup | None = None
    levels: list[Level] = field(default_factory=list)


def block_of_gram(keys: np.ndarray, blocks: int) -> np.ndarray:
    return ((mix64((keys >> np.uint64(8)) & np.uint64(0xFFFF)) >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)


def block_of_word(keys: np.ndarray, blocks: int) -> np.ndarray:
    return ((keys >> np.uint64(16)) % np.uint64(blocks)).astype(np.int64)


def higher_orders(full: tuple[np.ndarray, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Grams and counts of orders 2 to ORDER from those of the full order."""
    by_order = [full]
    for j in range(ORDER - 1, 1, -1):
        by_order.insert(0, _runs(by_order[0][0] & np.uint64((1 << 8 * (j + 1)) - 1)))
    return by_order


def make_block(number: int, blocks: int, words: tuple[np.ndarray, np.ndarray], full: tuple[np.ndarray, np.ndarray], low: list[tuple[np.ndarray, np.ndarray]], odds: list[Escapes] | None = None) -> Block:
    """``low`` has the grams of orders 0 and 1 of the whole model (at most 65536), ``full`` the full-order grams
    of the block, ``odds`` the escapes of the whole model (without them, of these grams)."""
    block = Block(number, blocks, Lookup(*words))
    block.word_logs = np.log10(block.words.values + 1.0)
    block.levels = build_levels([low[0], low[1], *higher_orders(full)], odds)
    top = block.levels[ORDER]
    ctx = _position(top.contexts, top.grams >> np.uint64(8))
    block.top = Lookup(top.grams, (top.log_count - top.log_total[ctx]))
    return block


def code_lengths(block: Block, keys: np.ndarray) -> np.ndarray:
    """log10 probability of each key's byte in its context."""
    at = block.top.find(keys)
    out = np.zeros(len(keys))
    out[at >= 0] = block.top.values[at[at >= 0]]
    left = np.flatnonzero(at < 0)
    if not len(left):
        return out
    k = keys[left]
    total, started, prior = np.zeros(len(left)), np.zeros(len(left), bool), np.zeros(len(left), np.int64)
    live = np.ones(len(left), bool)
    for j in range(ORDER, -1, -1):
        level = block.levels[j]
        part = k & np.uint64((1 << 8 * (j + 1)) - 1)
        ctx, gram = _position(level.contexts, part >> np.uint64(8)), _position(level.grams, part)
        above = block.levels[j + 1] if j < ORDER else None
        begin = live & ~started & (ctx >= 0)
        denominator, escape = np.zeros(len(k)), np.zeros(len(k))
        denominator[begin], escape[begin] = level.log_total[ctx[begin]], level.log_escape[ctx[begin]]
        going = live & started
        if above is not None:
            denominator[going], escape[going] = above.log_total_below[prior[going]], above.log_escape_below[prior[going]]
        active = begin | going
        found = active & (gram >= 0)
        total[found] += level.log_count[gram[found]] - denominator[found]
        missed = active & (gram < 0)
        total[missed] += escape[missed]
        live &= ~found
        started |= begin
        prior = np.where(ctx >= 0, ctx, prior)
    zero = block.levels[0]
    unseen = np.log10(256.0) if not len(zero.contexts) else zero.log_total_below[0]
    total[live] -= np.where(started[live], unseen, np.log10(256.0))
    out[left] = total
    return out


def _dealt(which: np.ndarray, blocks: int, *columns: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """The columns' entries of each block."""
    if blocks == 1:
        return [columns]
    order, edges = np.argsort(which, kind="stable"), np.cumsum(np.bincount(which, minlength=blocks))[:-1]
    return list(zip(*(np.split(c[order], edges) for c in columns), strict=True))


def score_batch(batch: list[bytes], parts: Iterator[Block], blocks: int, n_train: int, n_types: int, ends: int) -> dict[str, np.ndarray]:
    """Per text: n_tokens, n_known, base_score and score; ``parts`` gives each block of the model once.

    Words and grams are dealt to the blocks once, before the blocks are read."""
    n = len(batch)
    n_tokens, known, logs, score = np.ones(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
    known += ends > 0
    logs += np.log10(ends + 1.0)
    words, coded = [], []
    for i, j in slices([len(t) for t in batch], _SLICE):
        flat = flatten(batch[i:j])
        doc, h = tokens(flat)
        n_tokens[i:j] += np.bincount(doc, minlength=j - i)
        words.append((i, j, _dealt(block_of_word(h, blocks), blocks, doc.astype(np.int32), h)))
        for doc, keys in grams(flat):
            coded.append((i, j, _dealt(block_of_gram(keys, blocks), blocks, doc, keys)))
    for block in parts:
        for i, j, dealt in words:
            doc, h = dealt[block.number]
            at = block.words.find(h)
            doc, at = doc[at >= 0], at[at >= 0]
            known[i:j] += np.bincount(doc, minlength=j - i)
            logs[i:j] += np.bincount(doc, weights=block.word_logs[at], minlength=j - i)
        for i, j, dealt in coded:
            doc, keys = dealt[block.number]
            score[i:j] += np.bincount(doc, weights=code_lengths(block, keys), minlength=j - i)
    return {"n_tokens": n_tokens, "n_known": known, "base_score": logs - n_tokens * np.log10(n_train + (n_types + 1.0)), "score": score}


@dataclass
class Model:
    """Broadcast blocks and the totals of the training tokens."""

    blocks: list
    n_train: int
    n_types: int
    ends: int


def _arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    t = df.select("key", "n").toArrow()
    keys, n = t["key"].to_numpy().astype(np.int64).view(np.uint64), t["n"].to_numpy().astype(np.int64)
    order = np.argsort(keys)
    return keys[order], n[order]


def fit(docs: DataFrame, *, text_col: str = "text", block_rows: int = BLOCK_ROWS) -> Model:
    """Count the training rows ``docs`` and broadcast the model in blocks of about ``block_rows`` rows."""
    spark = docs.sparkSession
    counts = settle(count_model(docs, text_col=text_col))
    kinds = {r["kind"]: (r["rows"], r["n"]) for r in counts.groupBy("kind").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).collect()}
    ends = kinds.get(END, (0, 0))[1]
    words, n_words = kinds.get(WORD, (0, 0))
    blocks = max(1, -(-(words + kinds.get(GRAM, (0, 0))[0]) // block_rows))
    part = lambda df, j: df.select(F.col("key").bitwiseAND(F.lit((1 << 8 * (j + 1)) - 1)).alias("key"))
    one = settle(part(part(counts.where(F.col("kind") == GRAM), 2).distinct(), 1).groupBy("key").agg(F.count("*").alias("n")))
    low = [_arrays(part(one, 0).groupBy("key").agg(F.count("*").alias("n"))), _arrays(one)]
    ctx2 = F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF))
    sent = []
    if blocks == 1:
        sent.append(spark.sparkContext.broadcast(make_block(0, 1, _arrays(counts.where(F.col("kind") == WORD)), _arrays(counts.where(F.col("kind") == GRAM)), low)))
    else:
        home = block_of_gram(np.arange(1 << 16, dtype=np.uint64) << np.uint64(8), blocks)

        def full_of(b: int) -> tuple[np.ndarray, np.ndarray]:
            mine = spark.createDataFrame([(int(c),) for c in np.flatnonzero(home == b)], "ctx2 long")
            return _arrays(counts.where(F.col("kind") == GRAM).withColumn("ctx2", ctx2).join(F.broadcast(mine), "ctx2", "left_semi"))

        # A first reading of all blocks sums what their contexts have met; the second one builds them.
        odds = tally([*low, *higher_orders(full_of(0))])
        for b in range(1, blocks):
            for whole, more in zip(odds[2:], tally(higher_orders(full_of(b))), strict=True):
                whole.add(more)
        for b in range(blocks):
            own = F.pmod(F.shiftrightunsigned("key", 16), F.lit(blocks)) == b
            sent.append(spark.sparkContext.broadcast(make_block(b, blocks, _arrays(counts.where((F.col("kind") == WORD) & own)), full_of(b), low, odds)))
    return Model(sent, n_words + ends, words + (ends > 0), ends)


def score_texts(docs: DataFrame, model: Model, *, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """``id_cols`` with n_tokens, n_known, train_tokens, base_score and score of every row."""
    rows = small_batches(docs).select(*id_cols, F.col(text_col).alias("__text"))
    schema = rows.select(*id_cols).schema.add("n_tokens", "long").add("n_known", "long").add("train_tokens", "long").add("base_score", "double").add("score", "double")

    def parts() -> Iterator[Block]:
        for b in model.blocks:
            yield b.value
            if len(model.blocks) > 1 and hasattr(b, "_value"):
                del b._value  # the next use reads it from the executor's disk again

    def scored(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = score_batch([t for b in held for t in texts(b, "__text")], parts(), len(model.blocks), model.n_train, model.n_types, model.ends)
        first = 0
        for b in held:
            cols = [s[c][first : first + b.num_rows] for c in ("n_tokens", "n_known", "base_score", "score")]
            cols.insert(2, np.full(b.num_rows, model.n_train, np.int64))
            first += b.num_rows
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(id_cols))), *map(pa.array, cols)], schema.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if len(model.blocks) == 1 or size >= _HELD:
                yield from scored(held)
                held, size = [], 0
        if held:
            yield from scored(held)

    return rows.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text modulo 7 is 2 (null id: crc32 of the empty text, not held out)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2
