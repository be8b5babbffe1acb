"""Frequent phrases whose words keep together, found by Rabin-Karp fingerprints of word sequences."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .anchors import Hashes
from .packed import squeeze, unsqueeze
from .shared import dropped, written
from .text import BYTE_CODE, LOWER, mixed, run_hashes, utf8, word_runs

#: Bytes of text in a block; an n-gram is one row for each block that has it.
BLOCK_BYTES = 2 << 20
#: Texts that a task holds while it gathers blocks of several languages.
HELD_BYTES = 64 << 20
#: Bits of the broadcast table that says which fingerprints may be frequent: 16 MB.
TABLE_BITS = 27
#: Bits of a fingerprint that are counted; counts of n-grams that share one add up, and some rare ones are read for nothing.
PRINT_BITS = 44
#: Fingerprints that a task adds up before it passes them on.
HELD_PRINTS = 1_500_000
#: Fingerprints that are counted at once; their number of parts follows the number of words.
PART_PRINTS = 1 << 19

#: Bytes that end a piece: . , ; : ! ? and line feed to carriage return; words end at these, blanks and tabs.
CUTS = np.zeros(256, dtype=bool)
CUTS[[ord(c) for c in ".,;:!?"]] = CUTS[0x0A:0x0E] = True
IN_WORD = ~CUTS
IN_WORD[[0x20, 0x09]] = False
_TO_BLANKS = bytes(c if IN_WORD[c] else 0x20 for c in range(256))

BLOCKS = "block long, lang string, n_words long, text binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gather lower-cased texts of one language into blocks; a line feed keeps them apart."""
    task = TaskContext.get()
    number = (task.partitionId() if task else 0) << 32
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}

    def flushed(lang: str) -> pa.RecordBatch:
        nonlocal number
        raw = b"\n".join(held.pop(lang))
        size.pop(lang)
        number += 1
        packed = zstandard.ZstdCompressor(level=1).compress(raw)
        inside = IN_WORD[np.frombuffer(raw, np.uint8)]
        n_words = int(inside[:1].sum()) + int((inside[1:] & ~inside[:-1]).sum())
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([lang]), pa.array([n_words]), pa.array([packed], pa.binary())],
            names=["block", "lang", "n_words", "text"],
        )

    for batch in batches:
        data, bounds = utf8(batch.column("text"))
        cut = bounds.tolist()
        for i, lang in enumerate(batch.column("lang").to_pylist()):
            raw = LOWER[data[cut[i] : cut[i + 1]]].tobytes()
            if lang in held and size[lang] + len(raw) > BLOCK_BYTES:
                yield flushed(lang)
            held.setdefault(lang, []).append(raw)
            size[lang] = size.get(lang, 0) + len(raw) + 1
            if sum(size.values()) > HELD_BYTES:
                yield flushed(max(size, key=size.get))
    for lang in list(held):
        yield flushed(lang)


def _same_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each word has the bytes of the word that ``other`` points to."""
    n = ends - starts
    same = n == n[other]
    total = np.cumsum(n)
    each = np.repeat(np.arange(len(n)), n)
    at = np.arange(total[-1] if len(n) else 0) - (total - n)[each]
    unequal = data[starts[each] + at] != data[np.minimum(starts[other][each] + at, len(data) - 1)]
    same[each[unequal]] = False
    return same


class Block:
    """The words of a block and their exact numbers in it, and the n-grams that stand at each place."""

    def __init__(self, raw: bytes, lang: str) -> None:
        self.data = np.frombuffer(raw, np.uint8)
        self.starts, self.ends, _ = word_runs(self.data, np.array([0, len(self.data)]), IN_WORD)
        piece = np.cumsum(CUTS[self.data], dtype=np.int32)[self.starts]
        self.joined = piece[1:] == piece[:-1]
        codes = run_hashes(BYTE_CODE[self.data], self.starts, self.ends)
        _, first, number = np.unique(codes, return_index=True, return_inverse=True)
        # Words are equal by hash so far; their bytes decide.
        other = first[number]
        wrong = np.flatnonzero(~_same_bytes(self.data, self.starts, self.ends, other))
        more: dict[bytes, int] = {}
        for k in wrong.tolist():
            number[k] = len(first) + more.setdefault(raw[self.starts[k] : self.ends[k]], len(more))
        self.words, self.size = number, len(first) + len(more)
        # Prefix polynomials over the words' codes give the fingerprint of any sequence.
        self.hashes = Hashes(codes)
        self.seed = np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))

    def fingerprints(self, first: np.ndarray, length: int) -> np.ndarray:
        own = self.hashes.of(first, first + length)
        return mixed(own * np.uint64(0x9E3779B97F4A7C15) + self.seed + np.uint64(length))

    def ngrams(self, longest: int, table: np.ndarray | None, known: int):
        """For each length: (fingerprint, count, first place) of the block's distinct n-grams.

        An n-gram of which a part is rare cannot be frequent: parts of up to ``known`` words
        are looked up in the table, and n-grams over a rare one are left out.
        """
        number = self.words
        usable = np.ones(len(number), dtype=bool)
        for length in range(1, longest + 1):
            if length > 1:
                usable = usable[:-1] & usable[1:] & self.joined[length - 2 :]
                number = number[:-1] * self.size + self.words[length - 1 :]
            place = np.flatnonzero(usable)
            _, first, inverse, count = np.unique(number[place], return_index=True, return_inverse=True, return_counts=True)
            first = place[first]
            prints = self.fingerprints(first, length)
            if table is not None and length <= known:
                maybe = _looked_up(prints, table)
                usable[place] = maybe[inverse]
                prints, count, first = prints[maybe], count[maybe], first[maybe]
            yield length, prints, count, first
            # Numbers of n-grams for the next length; places that are not used have none.
            following = np.zeros(len(usable), np.int64)
            following[place] = inverse
            number = following


def _looked_up(prints: np.ndarray, table: np.ndarray) -> np.ndarray:
    slot = prints >> np.uint64(64 - TABLE_BITS)
    return (table[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, bytes]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            yield row, zstandard.ZstdDecompressor().decompress(row["text"])


def _packed(held: list[tuple[np.ndarray, np.ndarray]], bits: int) -> pa.RecordBatch:
    """Added counts as a row for each value of the first ``bits`` bits of the fingerprints."""
    prints, place = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
    count = np.bincount(place, np.concatenate([c for _, c in held]), len(prints)).astype(np.uint32)
    part = (prints >> np.uint64(PRINT_BITS - bits)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    runs = list(zip(first.tolist(), [*first[1:].tolist(), len(part)], strict=True))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(part[first]),
            pa.array([squeeze(np.diff(prints[a:b], prepend=np.uint64(0))) for a, b in runs], pa.binary()),
            pa.array([squeeze(count[a:b]) for a, b in runs], pa.binary()),
        ],
        names=["part", "prints", "counts"],
    )


def _counted(
    batches: Iterator[pa.RecordBatch], lengths: list[int], table: np.ndarray | None, bits: int
) -> Iterator[pa.RecordBatch]:
    """Fingerprints of the n-grams of the given lengths with their counts, added up over several blocks."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for row, raw in _opened(batches):
        for length, prints, count, _ in Block(raw, row["lang"]).ngrams(max(lengths), table, min(lengths) - 1):
            if length in lengths and len(prints):
                held.append((prints >> np.uint64(64 - PRINT_BITS), count))
        if sum(len(p) for p, _ in held) > HELD_PRINTS:
            yield _packed(held, bits)
            held = []
    if held:
        yield _packed(held, bits)


def _often(rows: pa.Table, least: int) -> pa.Table:
    """The fingerprints of one part that reach ``least``."""
    prints = [np.cumsum(unsqueeze(r, np.uint64), dtype=np.uint64) for r in rows.column("prints").to_pylist()]
    counts = [unsqueeze(r, np.uint32) for r in rows.column("counts").to_pylist()]
    every, place = np.unique(np.concatenate(prints), return_inverse=True)
    often = np.bincount(place, np.concatenate(counts), len(every)) >= least
    return pa.table({"print": pa.array(every[often].view(np.int64))})


def _read(batches: Iterator[pa.RecordBatch], longest: int, table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The n-grams that may be frequent as text, their words joined by blanks, from the place that points to each."""
    for row, raw in _opened(batches):
        words = raw.translate(_TO_BLANKS).split()
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        text, lang = b" ".join(words), row["lang"].encode() + b"\n"  # which is in no phrase
        for length, _, count, first in Block(raw, row["lang"]).ngrams(longest, table, longest):
            low, high = starts[first].tolist(), ends[first + length - 1].tolist()
            for k in range(0, len(first), 50_000):
                own = [lang + text[a:b] for a, b in zip(low[k : k + 50_000], high[k : k + 50_000], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.binary()).cast(pa.string()), pa.array(count[k : k + 50_000], pa.int64())],
                    names=["phrase", "f"],
                )


def _table(spark: SparkSession, prints: DataFrame) -> np.ndarray:
    """A bit for each value of the first bits of the fingerprints; at most 2^27 bits come to the driver."""
    slot = F.shiftrightunsigned("print", PRINT_BITS - TABLE_BITS)
    bits = prints.select((slot + 1).alias("slot"))
    bits = bits.groupBy(F.bitmap_bucket_number("slot").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    out = np.zeros(1 << (TABLE_BITS - 3), np.uint8)
    for row in bits.collect():
        low = (row["part"] - 1) * 4096
        out[low : low + 4096] = np.frombuffer(row["bits"], np.uint8)
    return out


def frequent_phrases(
    df: DataFrame, longest: int = 3, least: int = 10, text: str = "text", lang: str = "lang"
) -> tuple[DataFrame, DataFrame]:
    """Counts of all phrases of 1 to ``longest`` words that occur ``least`` times, and the words of each language.

    Texts are lower-cased in A-Z and cut into pieces at ``.,;:!?`` and line ends; a phrase is a run of words in
    one piece. Texts are gathered into blocks of one language. In a block equal words have equal
    numbers, by their bytes, and so have equal n-grams; each distinct n-gram of a block is a
    fingerprint, a count and a pointer to its first place. Fingerprints are counted, shorter n-grams
    first, as sorted lists by their first bits, which a task adds up over its blocks before they are shuffled; those that reach ``least`` mark a table of bits of fixed size, which the next
    length is filtered by, since all parts of a frequent phrase are frequent. The table only leaves out what is rare:
    phrases that share a bit with a frequent one are read for nothing, no frequent one is missed.
    In a last pass the blocks read the phrases that the table has by their pointers, and the
    texts are counted. So two phrases of one fingerprint are told apart, and the counts are exact.

    Result: (``lang``, ``phrase``, ``length``, ``f``) and (``lang``, ``n``). A null language is ``und``; a null or empty text has no
    words; repeated rows count each; no rows give no rows. Only the two named columns are read.
    """
    if longest < 2:
        raise ValueError("phrases have two words at least")
    spark = df.sparkSession
    rows = df.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").cast("string").alias("text")
    )
    blocks = written(rows.where("text IS NOT NULL").mapInArrow(_blocks, BLOCKS), "phrases-blocks")
    tokens = blocks.agg(F.sum("n_words")).first()[0] or 0
    bits = min(max((2 * tokens // PART_PRINTS).bit_length(), 4), PRINT_BITS)
    table = None
    for size in range(2, longest + 1):
        lengths = [1, 2] if size == 2 else [size]
        sent = spark.sparkContext.broadcast(table)
        counts = blocks.mapInArrow(
            lambda it, own=lengths, t=sent: _counted(it, own, t.value, bits), "part long, prints binary, counts binary"
        )
        often = counts.groupBy("part").applyInArrow(lambda rows: _often(rows, least), "print long")
        # Written, so that nothing keeps the shuffled lists while the next length is counted.
        often = written(often, "phrases-often")
        new = _table(spark, often)
        dropped(often)
        del counts, often
        table = new if table is None else table | new
    sent = spark.sparkContext.broadcast(table)
    read = blocks.mapInArrow(lambda it: _read(it, longest, sent.value), "phrase string, f long")
    counted = read.groupBy("phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    phrase = F.substring_index("phrase", "\n", -1)
    lang_of = F.expr("left(phrase, length(phrase) - length(substring_index(phrase, '\n', -1)) - 1)")
    length = F.size(F.split(phrase, " "))
    counted = counted.select(lang_of.alias("lang"), phrase.alias("phrase"), length.alias("length"), "f")
    counted = written(counted, "phrases-counted")
    words = written(blocks.groupBy("lang").agg(F.sum("n_words").alias("n")), "phrases-words")
    dropped(blocks)
    return counted, words


def collocations(
    counted: DataFrame, words: DataFrame, top: int = 2000, covered_percent: int = 50, scale: int = 1_000_000
) -> DataFrame:
    """The phrases of each language whose words keep together best, of the counts of :func:`frequent_phrases`.

    A phrase with count a is cut after its first k words, into parts that occur l and r times, and scores
    floor(scale * a * a / (l * r)); its lowest cut counts, of equal ones the first. A phrase inside a
    longer one that occurs at least ``covered_percent`` of a hundred times as often is left out. The first ``top`` by score, count and
    phrase (bytes ascending) stay.

    Result: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``. Scores are computed in decimals of 38 digits. Joins and
    the ranks of a language see frequent phrases only, and each partition passes on ``top`` of them at most.
    """
    counts = counted.select("lang", "phrase", "f")
    split = counted.where("length > 1").withColumnRenamed("f", "a").withColumn("w", F.split("phrase", " "))

    def part(first, size):
        return F.array_join(F.slice("w", first, size), " ")

    cut = split.select("lang", "a", "length", "w", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"))
    cut = cut.select(
        "lang", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("length") - F.col("k")).alias("right")
    )
    left = counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r")}
    cut = cut.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    cut = cut.withColumns({"above": wide["a"] * wide["a"] * scale, "below": wide["l"] * wide["r"]})
    scored = cut.withColumn("score", F.expr("above div below"))
    scored = scored.groupBy("lang", F.concat_ws(" ", "left", "right").alias("phrase"), "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("length") - 1),
            lambda m: F.transform(
                F.sequence(F.lit(1), F.col("length") - m + 1), lambda s: F.array_join(F.slice(F.col("w"), s, m), " ")
            ),
        )
    )
    inside = split.where("length > 2").select("lang", "a", F.explode(spans).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(inside, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * covered_percent)
    )
    kept = kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
