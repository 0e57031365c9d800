"""Phrase collocations: how often words stand together, against how often their parts stand anywhere.

Texts are scanned three times, in tasks that code words by numbers and count arrays of them.

1. Words are counted. Those below the threshold rule out every phrase with them (Apriori); the others leave a bit each in a
   bit array of fixed size.
2. Phrases of such words are counted by a hash into arrays of fixed size, with numpy, block by block summed over tasks.
   A place whose sum is below the threshold rules out its phrases; the others leave a bit. Bits may let too much through,
   never too little, and what is broadcast has the same size for any corpus.
3. Phrases whose words, parts and place all pass are written with their counts, once for each share of a task, dealt to blocks
   by a hash: sorted, so that they pack to a few bytes each. A block's different phrases are its candidates.

There are as many blocks as keep one bounded. Each gets a minimal perfect hash; mappers (some for each block) look the
written phrases up, compare them with the key stored at the slot, and count numpy arrays by slot, which are then summed
as a tree: the mappers' arrays of a block to one. Counts of phrases and of both parts of each cut are read from these
arrays by slot.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .minimal_hash import MinimalHash, mixed
from .shared import partitions, table

#: Fixed values, of the definition of a phrase: what parts words, and what ends a piece.
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(UPPER + b"\t" + PIECE_ENDS, LOWER + b" " + b"\n" * len(PIECE_ENDS))
#: Bits of a place in the fixed arrays, and of a place within a block of them.
PLACE, BLOCK_PLACE = 26, 16
#: Words that a share of a task holds at once, different words it remembers, words of the corpus for a block, mappers of a block.
#: Of so many words a fifth can be frequent phrases of two or three words at a threshold of ten.
SHARE, REMEMBERED, BLOCK_WORDS, MAPPERS = 6_000_000, 1_000_000, 2_000_000, 4
_SLICE = 4 << 20


def with_lang(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def seeds(lang: str) -> int:
    """Spark's xxhash64(lang) is the seed of its xxhash64(lang, word)."""
    return xxhash.xxh64_intdigest(lang.encode(), 42)


class Coder:
    """Numbers of one language's words. 0 is the end of a piece, 1 what isn't a word."""

    def __init__(self, lang: str, frequent: np.ndarray | None = None):
        self.lang, self.seed, self.frequent = lang, seeds(lang), frequent
        self.forget()

    def forget(self) -> None:
        self.number: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
        self.number[b"\n"], self.number[b""]  # noqa: B018
        self.words, self.hashes, self.passes = [b"\n", b""], np.zeros(2, np.uint64), np.zeros(2, bool)

    def code(self, data: bytes) -> np.ndarray:
        words = data.replace(b"\n", b" \n ").split(b" ")
        out = np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))
        new = list(itertools.islice(self.number, len(self.words), None))
        if new and self.frequent is not None:
            hashes = np.array([xxhash.xxh64_intdigest(w, self.seed) for w in new], np.uint64)
            self.hashes = np.append(self.hashes, hashes)
            self.passes = np.append(self.passes, has_bit(self.frequent, hashes & np.uint64((1 << PLACE) - 1)))
        self.words += new
        return out[out != 1]


def has_bit(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[(places >> np.uint64(3)).astype(np.int64)] >> (places & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _slices(texts: list[str]) -> Iterator[bytes]:
    """The texts of a language, end to end, cut at ends of pieces to a few MB where there are any."""
    held, size = [], 0
    for t in texts:
        data = t.encode().translate(_PLAIN)
        while len(data) > _SLICE and (cut := data.rfind(b"\n", 0, _SLICE)) > 0:
            yield data[:cut]
            data = data[cut:]
        held.append(data)
        size += len(data)
        if size > _SLICE:
            yield b"\n".join(held)
            held, size = [], 0
    if held:
        yield b"\n".join(held)


Shares = Iterator[tuple[Coder, np.ndarray]]


def shares(batches: Iterator[pa.RecordBatch], frequent: np.ndarray | None) -> Shares:
    """A task's words by language, coded, some millions at a time; a coder's numbers hold until its next share."""
    coders: dict[str, Coder] = {}
    held: dict[str, list[np.ndarray]] = defaultdict(list)
    waiting = 0

    def all_of(lang: str) -> Shares:
        coder = coders[lang]
        yield coder, np.concatenate(held.pop(lang))
        if len(coder.words) > REMEMBERED:
            coder.forget()

    for b in batches:
        for k in range(0, b.num_rows, 2000):
            langs, texts = (c.to_pylist() for c in b.slice(k, 2000).columns)
            by = defaultdict(list)
            for lang, text in zip(langs, texts, strict=True):
                by[lang].append(text)
            for lang, own in by.items():
                coder = coders.setdefault(lang, Coder(lang, frequent))
                for data in _slices(own):
                    codes = coder.code(data)
                    held[lang] += [codes, np.zeros(1, np.int32)]
                    waiting += len(codes)
                    if len(coder.words) > REMEMBERED:
                        waiting -= sum(map(len, held[lang]))
                        yield from all_of(lang)
            if waiting > SHARE:
                for lang in list(held):
                    yield from all_of(lang)
                waiting = 0
    for lang in list(held):
        yield from all_of(lang)


_COUNTED = "lang string, phrase string, n long"


def _batch(lang: str, phrases: list[bytes], counts: np.ndarray) -> pa.RecordBatch:
    texts = pa.array(phrases, pa.binary()).cast(pa.string())
    langs = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(phrases), np.int32)), [lang]).cast(pa.string())
    return pa.RecordBatch.from_arrays([langs, texts, pa.array(counts.astype(np.int64))], ["lang", "phrase", "n"])


def count_words(texts: DataFrame) -> DataFrame:
    """(lang, phrase, n): words, counted for each share of a task, and with the empty phrase how many there are of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for coder, codes in shares(batches, None):
            n = np.bincount(codes, minlength=2)
            n[:2] = 0
            at = np.flatnonzero(n)
            if len(at):
                yield _batch(coder.lang, [b"", *[coder.words[i] for i in at.tolist()]], np.append(n.sum(), n[at]))

    return texts.mapInArrow(run, _COUNTED)


def bits_of_words(frequent: DataFrame) -> np.ndarray:
    """A bit for each of the words (lang, phrase), at the low bits of its hash: 2^PLACE bits, however many words there are."""
    place = F.xxhash64("lang", "phrase").bitwiseAND(F.lit((1 << PLACE) - 1)) + 1  # Spark's buckets begin at 1
    bucket, position = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    rows = frequent.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(position).alias("bits"))
    return _placed([(bucket - 1, bits) for bucket, bits in rows.collect()], 4096)


def _placed(rows: list, size: int) -> np.ndarray:
    """One array of 2^PLACE bits from rows (number of a part, its bytes), parts having ``size`` bytes."""
    bits = np.zeros((1 << PLACE) // 8, np.uint8)
    for number, raw in rows:
        bits[number * size : (number + 1) * size] = np.frombuffer(raw, np.uint8)
    return bits


def _neighbours(coder: Coder, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places in codes where phrases of two and of three frequent words begin, and those phrases' places in the fixed arrays."""
    ok = coder.passes[codes]
    two = np.flatnonzero(ok[:-1] & ok[1:])
    three = two[:-1][np.diff(two) == 1] if len(two) else two
    h = coder.hashes
    shift = np.uint64(64 - PLACE)
    pair = mixed(h[codes[two]], h[codes[two + 1]])
    triple = mixed(mixed(h[codes[three]], h[codes[three + 1]]), h[codes[three + 2]])
    return two, three, pair >> shift, triple >> shift


def _sketched(texts: DataFrame, frequent) -> DataFrame:
    """(block long, counts binary): how often phrases fall to each place, up to 255, a block of places a row, for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << PLACE), np.uint8)
        for coder, codes in shares(batches, frequent.value):
            for kind, places in enumerate(_neighbours(coder, codes)[2:]):
                at, n = np.unique(places.astype(np.int64), return_counts=True)
                sums[kind, at] = np.minimum(sums[kind, at] + np.minimum(n, 255).astype(np.uint16), 255)
        blocks = sums.reshape(-1, 1 << BLOCK_PLACE)
        used = np.flatnonzero(blocks.any(axis=1))
        for k in range(0, len(used), 64):
            raw = [zlib.compress(x, 1) for x in blocks[used[k : k + 64]]]
            yield pa.RecordBatch.from_arrays([pa.array(used[k : k + 64]), pa.array(raw, pa.binary())], ["block", "counts"])

    return texts.mapInArrow(run, "block long, counts binary")


def bits_of_phrases(texts: DataFrame, frequent, least: int) -> list[np.ndarray]:
    """For phrases of two and of three words, a bit for each place whose sum over all tasks is at least ``least``."""
    most = min(least, 255)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, None
        for b in itertools.chain(batches, [None]):
            for block, raw in zip(*(c.to_pylist() for c in b.columns), strict=True) if b is not None else [(None, b"")]:
                if block != last:
                    if last is not None and (total >= most).any():
                        bits = np.packbits(total >= most, bitorder="little").tobytes()
                        yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([bits], pa.binary())], ["block", "bits"])
                    last, total = block, np.zeros(1 << BLOCK_PLACE, np.int64)
                if block is not None:
                    total += np.frombuffer(zlib.decompress(raw), np.uint8)

    summed = _sketched(texts, frequent).repartition(partitions(texts.sparkSession), "block").sortWithinPartitions("block")
    rows = summed.mapInArrow(run, "block long, bits binary").collect()  # 2^PLACE bits for each length at most
    half, size = 1 << (PLACE - BLOCK_PLACE), (1 << BLOCK_PLACE) // 8
    return [_placed([(b - k * half, x) for b, x in rows if b // half == k], size) for k in (0, 1)]


_PACKED = "lang string, block int, phrases binary, counts binary"


def _packed(coder: Coder, phrases: list[bytes], counts: np.ndarray, blocks: int) -> pa.RecordBatch:
    """Phrases and their counts as a row for each block, by the hash that Spark's xxhash64(lang, phrase) gives."""
    digest, seed = xxhash.xxh64_intdigest, coder.seed
    block = np.array([digest(p, seed) for p in phrases], np.uint64).view(np.int64) % blocks
    order = np.argsort(block, kind="stable")
    used, starts = np.unique(block[order], return_index=True)
    rows = [sorted(order[a:b].tolist(), key=phrases.__getitem__) for a, b in zip(starts, [*starts[1:], len(order)], strict=True)]
    texts = [zlib.compress(b"\n".join([phrases[i] for i in own]), 1) for own in rows]
    n = [zlib.compress(counts[own].astype(np.uint32).tobytes(), 1) for own in rows]
    arrays = [pa.array([coder.lang] * len(used)), pa.array(used.astype(np.int32)), pa.array(texts, pa.binary()), pa.array(n, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, ["lang", "block", "phrases", "counts"])


def _written(texts: DataFrame, frequent, two_bits, three_bits, blocks: int) -> DataFrame:
    """(lang, block, phrases, counts): what may be frequent, counted for each share of a task and packed by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for coder, codes in shares(batches, frequent.value):
            n = np.bincount(codes, minlength=len(coder.words))
            ones = np.flatnonzero((n > 0) & coder.passes[: len(n)])
            two, three, pairs, triples = _neighbours(coder, codes)
            passed = np.zeros(len(codes) + 1, bool)
            passed[two] = has_bit(two_bits.value, pairs)
            two = np.flatnonzero(passed)
            three = three[has_bit(three_bits.value, triples) & passed[three] & passed[three + 1]]
            wide, base = codes.astype(np.int64), len(coder.words)
            heads: list[bytes] = coder.words
            begins = wide
            if len(ones):
                yield _packed(coder, [coder.words[i] for i in ones.tolist()], n[ones], blocks)
            for at, size in ((two, 2), (three, 3)):
                keys, where, n = np.unique(begins[at] * base + wide[at + size - 1], return_inverse=True, return_counts=True)
                ends = zip((keys // base).tolist(), (keys % base).tolist(), strict=True)
                heads = [b"%b %b" % (heads[a], coder.words[b]) for a, b in ends]
                begins = np.zeros(len(codes), np.int64)
                begins[at] = where
                if len(heads):
                    yield _packed(coder, heads, n, blocks)

    return texts.mapInArrow(run, _PACKED)


def _keys(lang: str, packed: bytes) -> list[bytes]:
    """The keys of packed phrases. No phrase holds a tab or line feed; its language, which might, stands before it in hex."""
    head = lang.encode().hex().encode() + b"\t"
    return [head + p for p in zlib.decompress(packed).split(b"\n")]


def _halves(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


_TABLES = "block int, hash binary, keys binary"


def _hashed(written: DataFrame) -> DataFrame:
    """For each block the minimal perfect hash of its different phrases, and these by slot."""

    def made(block: int, keys: set[bytes]) -> pa.RecordBatch:
        listed = sorted(keys)
        table = MinimalHash.of(*_halves(listed))
        by_slot = [listed[i] for i in np.argsort(table.slots(*_halves(listed))).tolist()]
        arrays = [pa.array([block], pa.int32()), pa.array([table.to_bytes()], pa.binary()), pa.array([zlib.compress(b"\n".join(by_slot), 1)], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["block", "hash", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, keys = None, set()
        for b in batches:
            for own, lang, packed in zip(*(b[c].to_pylist() for c in ("block", "lang", "phrases")), strict=True):
                if own != block:
                    if keys:
                        yield made(block, keys)
                    block, keys = own, set()
                keys.update(_keys(lang, packed))
        if keys:
            yield made(block, keys)

    dealt = written.select("block", "lang", "phrases").repartition(partitions(written.sparkSession), "block").sortWithinPartitions("block")
    return dealt.mapInArrow(run, _TABLES)


class Slots:
    """A block as a task holds it."""

    def __init__(self, made: bytes, keys: bytes, counts: bytes | None):
        self.hash, self.keys = MinimalHash.from_bytes(made), zlib.decompress(keys).split(b"\n")
        self.counts = np.zeros(len(self.keys), np.int64) if counts is None else np.frombuffer(counts, np.int64)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Slots, -1 for what isn't the key that is stored there."""
        at = self.hash.slots(*_halves(keys))
        return np.array([s if s >= 0 and self.keys[s] == k else -1 for s, k in zip(at.tolist(), keys, strict=True)], np.int64)


Seen = Callable[[Slots, pa.RecordBatch], pa.RecordBatch | None]


def _at_slots(tables: DataFrame, rows: DataFrame, schema: str, seen: Seen, done: Callable[[Slots, int], pa.RecordBatch] | None) -> DataFrame:
    """What becomes of rows (block, mapper, ...) at their block's tables (block, hash, keys, maybe slot_counts).

    Rows are dealt by block and mapper and sorted, a block's tables ahead of them, so a task streams them past one block at
    a time: ``seen`` makes rows of a batch, and ``done`` one of a block at its end."""
    ahead = tables.withColumns({"mapper": F.explode(F.sequence(F.lit(0), F.lit(MAPPERS - 1))), "kind": F.lit(0)})
    both = ahead.unionByName(rows.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    dealt = both.repartition(partitions(rows.sparkSession), "block", "mapper").sortWithinPartitions("block", "mapper", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, block = None, -1
        for b in batches:
            kind = b["kind"].to_numpy()
            turns = np.flatnonzero(kind == 0)
            borders = np.unique(np.concatenate([[0], turns, turns + 1, [len(kind)]])).tolist()
            for lo, hi in itertools.pairwise(borders):
                part = b.slice(lo, hi - lo)
                if kind[lo] == 0:
                    if slots is not None and done:
                        yield done(slots, block)
                    one = part.to_pylist()[0]
                    slots, block = Slots(one["hash"], one["keys"], one.get("slot_counts")), one["block"]
                elif slots is not None and (out := seen(slots, part)) is not None:
                    yield out
        if slots is not None and done:
            yield done(slots, block)

    return dealt.mapInArrow(run, schema)


def _count(slots: Slots, part: pa.RecordBatch) -> None:
    for lang, phrases, counts in zip(*(part[c].to_pylist() for c in ("lang", "phrases", "counts")), strict=True):
        at = slots.find(_keys(lang, phrases))
        n = np.frombuffer(zlib.decompress(counts), np.uint32)[at >= 0]
        slots.counts += np.bincount(at[at >= 0], n, len(slots.counts)).astype(np.int64)


def _counts_of(slots: Slots, block: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([slots.counts.tobytes()], pa.binary())], ["block", "slot_counts"])


def _sum(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.int64) for x in group["slot_counts"].to_pylist())
    return pa.table({"block": group["block"][:1].combine_chunks(), "slot_counts": [total.tobytes()]})


def count_at_slots(tables: DataFrame, written: DataFrame) -> DataFrame:
    """The tables with the counts of what is written by slot: mappers' arrays, summed."""
    spread = written.withColumn("mapper", F.spark_partition_id() % MAPPERS)
    arrays = _at_slots(tables, spread, "block int, slot_counts binary", _count, _counts_of)
    return tables.join(arrays.groupBy("block").applyInArrow(_sum, "block int, slot_counts binary"), "block")


def read_at_slots(tables: DataFrame, rows: DataFrame, part: str, blocks: int) -> DataFrame:
    """rows (lang, phrase, ...) with f, the count of the phrase in column ``part``. A part that many phrases share is looked
    up by several mappers."""
    kept = rows.columns
    mapper = F.pmod(F.xxhash64("phrase"), F.lit(MAPPERS)).cast("int")
    asked = rows.withColumns({"block": F.pmod(F.xxhash64("lang", part), F.lit(blocks)).cast("int"), "mapper": mapper})

    def seen(slots: Slots, batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = [f"{lang.encode().hex()}\t{p}".encode() for lang, p in zip(batch["lang"].to_pylist(), batch[part].to_pylist(), strict=True)]
        at = slots.find(keys)
        f = np.where(at >= 0, slots.counts[at], 0)
        return pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(f)], [*kept, "f"])

    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return _at_slots(tables, asked, f"{schema}, f long", seen, None)


def frequent_at_slots(tables: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, a): phrases of several words that reach the threshold, by slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, raw in zip(b["keys"].to_pylist(), b["slot_counts"].to_pylist(), strict=True):
                counts = np.frombuffer(raw, np.int64)
                listed = zlib.decompress(keys).split(b"\n")
                at = [i for i in np.flatnonzero(counts >= least).tolist() if b" " in listed[i]]
                parts = [listed[i].decode().split("\t") for i in at]
                langs, texts = [bytes.fromhex(p[0]).decode() for p in parts], [p[1] for p in parts]
                arrays = [pa.array(langs, pa.string()), pa.array(texts, pa.string()), pa.array(counts[at])]
                yield pa.RecordBatch.from_arrays(arrays, ["lang", "phrase", "a"])

    return tables.select("keys", "slot_counts").mapInArrow(run, "lang string, phrase string, a long")


def _cut(k: int) -> Column:
    """floor(1000000 * a * a / (l * r)) of a cut, exactly: products have up to 38 digits."""
    return F.expr(f"(cast(a as decimal(38,0)) * a * 1000000) div (cast(l{k} as decimal(38,0)) * r{k})")


def phrases(docs: DataFrame, least: int = 10, limit: int = 2000, inside: int = 50) -> DataFrame:
    """The first ``limit`` phrases of two or three words of each language: (lang, rank, phrase, a, l, r, n, score).

    docs are (text, lang); other columns aren't read. A null language is ``und``, a null or empty text has no word. Counts are
    over all documents, each row by itself, repeated ones too. Phrases with fewer than ``least`` occurrences don't count as
    candidates; one that stands inside a longer candidate with ``inside`` percent of its occurrences or more is dropped. Equal scores
    are ranked by occurrences, then by the phrase's bytes. A language without such phrases, or an empty table, gives no row.
    """
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast
    texts = with_lang(docs)
    words = count_words(texts).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    words = table(words.where((F.col("n") >= least) | (F.col("phrase") == "")), "frequent-words")
    totals = words.where("phrase = ''").select("lang", "n")
    of_words = send(bits_of_words(words.where("phrase <> ''")))
    bits = [send(b) for b in bits_of_phrases(texts, of_words, least)]
    total = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = max(partitions(spark), -(-total // BLOCK_WORDS))
    written = table(_written(texts, of_words, *bits, blocks), "phrases")
    tables = table(_hashed(written), "hashes")
    tables = table(count_at_slots(tables, written), "slots")
    known = table(frequent_at_slots(tables, least), "frequent-phrases")
    return ranked(known, tables, blocks, limit, inside).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def ranked(known: DataFrame, tables: DataFrame, blocks: int, limit: int, inside: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, score) of the candidates (lang, phrase, a)."""
    w = F.split("phrase", " ")
    first, last = F.element_at(w, 1), F.element_at(w, -1)
    head, tail = (F.array_join(F.slice(w, x, 2), " ") for x in (1, 2))
    three = F.size(w) == 3
    part = lambda name, c: F.struct(F.lit(name).alias("name"), c.alias("part"))
    pairs = F.array(part("l1", first), part("r1", last))
    triples = F.array(part("l1", first), part("r1", tail), part("l2", head), part("r2", last))
    asked = known.select("lang", "phrase", "a", F.explode(F.when(three, triples).otherwise(pairs)).alias("x")).select("lang", "phrase", "a", "x.*")
    answers = read_at_slots(tables, asked, "part", blocks)
    cuts = answers.groupBy("lang", "phrase", "a").agg(*[F.max(F.when(F.col("name") == c, F.col("f"))).alias(c) for c in ("l1", "r1", "l2", "r2")])

    longer = known.where(three).select("lang", "a", F.explode(F.array_distinct(F.array(head, tail))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = cuts.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < inside * F.col("a"), F.lit(True)))
    second = F.coalesce(_cut(2) < _cut(1), F.lit(False))
    scored = kept.select(
        "lang", "phrase", "a",
        F.when(second, F.col("l2")).otherwise(F.col("l1")).alias("l"),
        F.when(second, F.col("r2")).otherwise(F.col("r1")).alias("r"),
        F.least(_cut(1), _cut(2)).alias("score"),
    )
    spread = F.xxhash64("phrase")
    for width in (blocks, int(blocks**0.5)):  # a language's best are found among the best of its parts
        by = Window.partitionBy("lang", F.pmod(spread, F.lit(width))).orderBy(F.desc("score"), F.desc("a"), "phrase")
        scored = scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit)
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit)
