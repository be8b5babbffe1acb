"""Power-of-two packing of tokenised documents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import slices, utf8

#: Words whose ids a task keeps; beyond it the cache starts anew.
CACHE_WORDS = 800_000
#: Distinct words given to the tokenizer at once.
ENCODE_WORDS = 4_000

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long"


class _Slots(dict):
    """Number words in the order in which they come."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n


#: Words that fall into letters and a run of marks, whose ids follow from those two parts:
#: letters without a composed form other than themselves, and ASCII marks but the apostrophe.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*)([-.,;:!?()#*$%&|<>+=/_]*)")


def _cut(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The ids' bytes from each start to its end."""
    raw = ids.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


class WordEncoder:
    """Token ids of texts, from ids of their distinct words.

    The tokenizer must drop white space and treat what it separates apart, as those
    with word ends do: then the ids of a text are the ids of its words, one after
    another, and each distinct word is encoded once. If the tokenizer also lower-cases
    and splits letters from marks, words are put together from such parts, of which
    there are fewer; :meth:`_joins` tries both on a probe.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.marks = [m.encode() for m in special]
        self.mark, self.mark_id = next(iter(special.items()), (None, -1))
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.joins = self._joins()
        self.clear()

    def _joins(self) -> bool:
        alike = all(
            self._ids(a).tolist() == self._ids(b).tolist()
            for a, b in (("Abc,", "abc ,"), ("\u00c9t\u00e9.", "\u00e9t\u00e9 ."), ("X!!", "x !!"))
        )
        return alike and self.ends[self._ids("abc , \u00e9t\u00e9")].sum() == 3

    def clear(self) -> None:
        """Forget the words, not the tokenizer."""
        self.slots = _Slots()
        self.parts: dict[str, bytes] = {}
        self.flat = np.zeros(0, np.uint32)
        self.lengths = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as bytes: joined by a special token, which separates and shows up."""
        if self.mark is None or any(m in w for w in words for m in self.marks):
            if len(words) == 1 or self.mark is None:
                return [self._ids(w.decode("utf-8", "replace")).tobytes() for w in words]
            half = len(words) // 2
            return self._encode(words[:half]) + self._encode(words[half:])
        ids = self._ids(self.mark.join(w.decode("utf-8", "replace") for w in words))
        marks = 4 * np.flatnonzero(ids == self.mark_id)
        return _cut(ids, np.append(0, marks + 4), np.append(marks, 4 * len(ids)))

    def _learn(self, parts: list[str]) -> None:
        """Ids of letters and marks, joined by blanks: the last id of each one ends a word."""
        joined = [" ".join(parts[i : i + 500]) for i in range(0, len(parts), 500)]
        ids = np.concatenate(
            [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        )
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(parts):
            raise ValueError("the tokenizer does not mark the ends of words as expected")
        self.parts.update(zip(parts, _cut(ids, 4 * np.append(0, cuts[:-1]), 4 * cuts), strict=True))

    def _found(self, new: list[bytes]) -> list[bytes]:
        """Ids of each new word, as bytes, which take less room than an array for each."""
        split = [PLAIN.fullmatch(w.decode("utf-8", "replace")) if self.joins else None for w in new]
        pairs = [m and (m[1].lower(), m[2]) for m in split]
        unknown = list({x: None for p in pairs if p for x in p if x and x not in self.parts})
        if unknown:
            self._learn(unknown)
        rest = [i for i, p in enumerate(pairs) if not p]
        odd = [new[i] for i in rest]
        coded = [x for i in range(0, len(odd), ENCODE_WORDS) for x in self._encode(odd[i : i + ENCODE_WORDS])]
        by_place = dict(zip(rest, coded, strict=True))
        parts = self.parts
        return [
            by_place[i] if not p else parts[p[0]] + parts[p[1]] if p[0] and p[1] else parts[p[0] or p[1]]
            for i, p in enumerate(pairs)
        ]

    def __call__(self, text: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the number of ids of each text."""
        if len(self.slots) > CACHE_WORDS:
            self.clear()
        words = [t.split() for t in text]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        at = np.concatenate(
            [np.fromiter(map(self.slots.__getitem__, w), np.int64, len(w)) for w in words]
            or [np.zeros(0, np.int64)]
        )
        new, self.slots.new = self.slots.new, []
        if new:
            found = self._found(new)
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(found), np.uint32)])
            self.lengths = np.concatenate([self.lengths, np.fromiter(map(len, found), np.int64, len(found)) // 4])
            self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        shift = np.repeat(self.starts[at] - (ends - lengths), lengths)
        ids = self.flat[shift + np.arange(total)]
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(upto)


@cache
def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker, so that its words outlive a task."""
    return WordEncoder(path)


def binary_pieces(n: int, longest: int) -> list[int]:
    """Lengths that add up to n: the longest power as often as it fits, then its binary digits."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _cut_up(batch: pa.RecordBatch, encode: WordEncoder, longest: int, end_id: int) -> Iterator[pa.RecordBatch]:
    data, bounds = utf8(batch.column(1))
    for low, high in slices(bounds):
        raw = data[bounds[low] : bounds[high]].tobytes()
        cut = (bounds[low : high + 1] - bounds[low]).tolist()
        ids, counts = encode([raw[a:b] for a, b in zip(cut, cut[1:], strict=False)])
        ids = np.insert(ids, np.cumsum(counts), np.uint32(end_id))
        counts = counts + 1
        sizes = [binary_pieces(n, longest) for n in counts.tolist()]
        n_pieces = np.fromiter(map(len, sizes), np.int64, len(sizes))
        length = np.array([x for s in sizes for x in s], np.int64)
        ends = np.cumsum(length)
        doc = np.repeat(np.arange(low, high), n_pieces)
        first = np.repeat(np.cumsum(counts) - counts, n_pieces)
        offsets = np.concatenate([[0], ends * 4]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(doc)).cast(pa.int64()),
                pa.array(ends - length - first),
                pa.array(length),
                pa.Array.from_buffers(
                    pa.binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u4"))]
                ),
                pa.array(np.repeat(counts, n_pieces)),
            ],
            names=["doc_id", "start", "length", "ids", "doc_tokens"],
        )


def _packed(
    batches: Iterator[pa.RecordBatch], path: str, longest: int, end_id: int, keep_words: bool = True
) -> Iterator[pa.RecordBatch]:
    encode = encoder(path)
    try:
        for batch in batches:
            yield from _cut_up(batch, encode, longest, end_id)
    finally:
        if not keep_words:
            encode.clear()


def pack_powers_of_two(
    df: DataFrame,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    longest: int = 4096,
    end_id: int = 2,
    keep_words: bool = True,
) -> DataFrame:
    """Cut each document's tokens into pieces whose lengths are powers of two.

    A document of n ids (``end_id`` included, after the ids of its text) gives n //
    ``longest`` pieces of that length and one piece for each binary digit of the rest,
    longest first. A piece is a sequence of its own, so no sequence crosses documents
    and none is padded; ``bucket`` is the binary logarithm of its length, and batches
    are formed of sequences of one bucket. ``ids`` holds the piece's ids as unsigned
    little-endian 32-bit integers.

    Nothing is shuffled: a piece depends on its document alone, and a sequence's number
    on its task and place in it. Use a tokenizer with word ends (see
    :class:`WordEncoder`); its file must be at ``tokenizer`` on every machine.

    A Python worker keeps the words that it has encoded for its next tasks, a few hundred MB that it holds
    while it runs other operators, too; with ``keep_words=False`` they go at the end of each task.

    A null or empty text is one piece with ``end_id``; a null id stays null; repeated rows
    are packed each; no rows give no rows. Only the two named columns are read.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    pieces = rows.mapInArrow(lambda it: _packed(it, tokenizer, longest, end_id, keep_words), PIECES)
    return pieces.select(
        "*",
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.round(F.log2("length")).cast("int").alias("bucket"),
    )


def bucket_sizes(pieces: DataFrame) -> DataFrame:
    """Sequences and tokens of each bucket, for a schedule of lengths."""
    return pieces.groupBy("bucket").agg(F.count("*").alias("n_sequences"), F.sum("length").alias("n_tokens"))
