"""Repeated passages found with suffix trees over groups of suffixes that share a prefix."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Hashes, covered, in_parts, keyed, repeated_stretches
from .shared import dropped, written
from .text import BYTE_CODE, fingerprint, quoted, run_hashes

#: Blocks that a suffix of ``length`` words is read in where a prefix is made longer.
BLOCKS = 5
#: Suffixes with a common prefix that are put into memory; groups with more get a longer prefix.
SUBTREE_ROWS = 50_000
RESULT = "doc_id long, fp long, n_words long, n_removed long, kept string, kept_sha256 string"
_DONE = [("doc_id", pa.int64()), ("fp", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string())]
RESULT_NAMES = [name for name, _ in _DONE]


def maximal_repeats(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, shortest: int):
    """The internal nodes of a suffix tree that are at least ``shortest`` symbols deep, and maximal to the left.

    The suffixes ``codes[starts:ends]`` are sorted; the common prefixes of neighbours make the tree: a node of depth
    d is a largest run of neighbours that share d symbols, and two of them no more. A node whose suffixes all come
    after the same symbol is part of a longer repeat and is left out. A suffix that begins its string
    (``starts`` as before it, another ``ends``) comes after no symbol. Yields (depth, suffixes, node of each).
    """
    deepest = int((ends - starts).max()) if len(starts) else 0
    if deepest < shortest:
        return
    at = starts[:, None] + np.arange(deepest)
    inside = at < ends[:, None]
    table = np.where(inside, codes[np.minimum(at, len(codes) - 1)] + 1, 0).astype(">u4")
    order = np.argsort(np.ascontiguousarray(table).view(f"S{4 * deepest}").ravel(), kind="stable")
    table = table[order]
    same = (table[1:] == table[:-1]) & (table[1:] > 0)
    common = np.where(same.all(axis=1), deepest, same.argmin(axis=1))
    first = np.concatenate([[True], ends[1:] != ends[:-1]])  # of its string
    before = np.where(first, -1 - np.arange(len(starts)), codes[starts - 1])[order]
    for depth in range(shortest, deepest + 1):
        joined = common >= depth
        if not joined.any():
            return
        run = np.concatenate([[0], np.cumsum(~joined)])
        begin = np.flatnonzero(np.concatenate([[True], ~joined]))
        exact = np.zeros(len(begin), dtype=bool)
        exact[run[1:][common == depth]] = True
        diverse = np.minimum.reduceat(before, begin) != np.maximum.reduceat(before, begin)
        member = (exact & diverse)[run]
        if member.any():
            yield depth, order[member], run[member]


def earlier_windows(strings: list[list[bytes]], keys: np.ndarray, shortest: int) -> np.ndarray:
    """Which windows of ``shortest`` words of the strings are also in a string with a smaller key, one after another."""
    number: dict[bytes, int] = {}
    codes = np.array([number.setdefault(w, len(number)) for words in strings for w in words], np.int64)
    size = np.array([len(words) for words in strings], np.int64)
    windows = size - shortest + 1
    string = np.repeat(np.arange(len(strings)), windows)
    own = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    end = np.cumsum(size)
    starts, ends = (end - size)[string] + own, end[string]
    key = keys[string]
    edge = np.zeros(len(string) + 1, np.int64)
    for depth, suffix, node in maximal_repeats(codes, starts, ends, shortest):
        _, node = np.unique(node, return_inverse=True)
        least = np.full(node.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, node, key[suffix])
        hit = suffix[key[suffix] > least[node]]  # the whole stretch from here on is in an earlier string
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + depth - shortest + 1, -1)
    return np.cumsum(edge[:-1]) > 0


def subtree_repeats(blocks: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which suffixes also start in a document with a smaller key, by a suffix tree.

    ``blocks`` has a row of symbols for each suffix. Sorted suffixes and the common
    prefixes of neighbours are the tree: an internal node of some depth is a maximal run of
    neighbours that share that many symbols. The nodes as deep as a row is long are the
    repeats; a suffix repeats if its node holds a smaller key.
    """
    order = np.lexsort((key, *blocks.T[::-1]))
    blocks, key = blocks[order], key[order]
    same = blocks[1:] == blocks[:-1]
    shared = np.cumprod(same, axis=1).sum(axis=1)  # symbols in common with the neighbour before
    node = np.concatenate([[0], np.cumsum(shared < blocks.shape[1])])
    first = np.concatenate([[0], np.flatnonzero(np.diff(node)) + 1])
    out = np.zeros(len(key), dtype=bool)
    out[order] = key > key[first][node]
    return out


def _grown(pdf: pd.DataFrame) -> pd.DataFrame:
    """The suffixes that repeat, of the groups that share a bucket; each group is a subtree."""
    if not len(pdf):
        return pdf[["key", "fp", "s"]]
    blocks = pdf[[f"b{k}" for k in range(BLOCKS)]].to_numpy(np.int64)
    return pdf.loc[subtree_repeats(blocks, pdf["key"].to_numpy(np.int64)), ["key", "fp", "s"]]


def grow_subtrees(suffixes: DataFrame, rows: int = SUBTREE_ROWS) -> DataFrame:
    """Suffixes that also start in a document with a smaller key.

    Groups of suffixes with a common prefix are counted; a group with more than ``rows``
    suffixes is split by a longer prefix, until its prefix is the whole suffix: such a
    group is one leaf or one deepest node, and the smallest key decides, which a plain
    aggregate finds, whatever the group's size. The other groups are dealt to buckets of
    about ``rows`` suffixes, whose number follows the number of suffixes; a bucket holds
    whole groups, fits in memory, and its subtrees are built at once.
    """
    columns = [f"b{k}" for k in range(BLOCKS)]
    left, out = suffixes, []
    for depth in range(1, BLOCKS):
        prefix = columns[:depth]
        sizes = left.groupBy(*prefix).agg(
            F.count("*").alias("size"), F.min("key").alias("least"), F.max("key").alias("most")
        )
        fits = sizes.where((F.col("size") <= rows) & (F.col("least") < F.col("most"))).select(*prefix)
        buckets = 1 + left.count() // rows
        group = left.join(fits, prefix, "left_semi").withColumn("bucket", F.pmod(F.xxhash64(*prefix), F.lit(buckets)))
        out.append(group.groupBy("bucket").applyInPandas(_grown, "key long, fp long, s int"))
        large = sizes.where((F.col("size") > rows) & (F.col("least") < F.col("most"))).select(*prefix)
        left = written(left.join(large, prefix, "left_semi"), "tree-large")
        if left.isEmpty():
            break
    else:
        least = left.groupBy(*columns).agg(F.min("key").alias("least"))
        whole = left.join(least, columns).where("key > least")
        out.append(whole.select("key", "fp", "s"))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


PIECES = "h long, seg long, least long, size long, n int, text binary"


def _pieces(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The words of the stretches that a document stands for."""
    names = ["h", "seg", "least", "size", "n", "text"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    for some in in_parts(batches):
        for row in some:
            words = row["text"].encode().split()
            found = row["found"]
            text = [b" ".join(words[x["s"] : x["s"] + x["n"] - 1 + window]) for x in found]
            columns = [[x[c] for x in found] for c in names[:5]] + [text]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _tree(pdf: pd.DataFrame, window: int) -> pd.DataFrame:
    """The windows of each string that an earlier string has, as runs; the strings are those of whole groups."""
    strings = [bytes(t).split(b" ") for t in pdf["text"]]
    hit = earlier_windows(strings, pdf["least"].to_numpy(np.int64), window)
    n = pdf["n"].to_numpy(np.int64)
    string = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(string)) - np.repeat(np.cumsum(n) - n, n)
    begin = np.flatnonzero(hit & np.concatenate([[True], ~hit[:-1] | (string[1:] != string[:-1])])) if len(hit) else np.zeros(0, int)
    last = np.flatnonzero(hit & np.concatenate([~hit[1:] | (string[1:] != string[:-1]), [True]])) if len(hit) else begin
    seg = pdf["seg"].to_numpy(np.int64)[string[begin]]
    return pd.DataFrame({"seg": seg, "from": place[begin].astype(np.int32), "n": (last - begin + 1).astype(np.int32)})


def _blocks(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The suffixes of strings, as a hash of each of their blocks, up to the window's length."""
    size = window // BLOCKS
    names = [*(f"b{k}" for k in range(BLOCKS)), "key", "fp", "s"]
    for some in in_parts(batches):
        for row in some:
            raw = np.frombuffer(row["text"] + b" ", np.uint8)
            ends = np.flatnonzero(raw == 0x20)
            starts = np.concatenate([[0], ends[:-1] + 1])
            hashes = Hashes(run_hashes(BYTE_CODE[raw], starts, ends))
            s = np.arange(row["n"])
            blocks = [hashes.of(s + k * size, s + (k + 1) * size).view(np.int64) for k in range(BLOCKS)]
            own = [np.full(len(s), row["least"]), np.full(len(s), row["seg"]), s.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*blocks, *own)], names=names)


def earlier_stretches(pieces: DataFrame, window: int, rows: int = SUBTREE_ROWS) -> DataFrame:
    """(seg, from, n): runs of windows of the strings that also stand in a string with a smaller key.

    Strings are grouped by the gram that their anchors begin with, the prefix that these suffixes share;
    equal windows are in one group. Groups of up to ``rows`` suffixes are dealt to buckets that fit in memory, and
    a suffix tree over each bucket's strings gives the repeats. Larger groups get longer prefixes
    (:func:`grow_subtrees`).
    """
    small, large = pieces.where(F.col("size") <= rows), pieces.where(F.col("size") > rows)
    buckets = 1 + (small.agg(F.sum("n")).first()[0] or 0) // rows
    dealt = small.withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets))).select("bucket", "seg", "least", "n", "text")
    found = dealt.groupBy("bucket").applyInPandas(lambda pdf: _tree(pdf, window), "seg long, from int, n int")
    if large.isEmpty():
        return found
    schema = ", ".join([*(f"b{k} long" for k in range(BLOCKS)), "key long, fp long, s int"])
    suffixes = written(large.select("seg", "least", "n", "text").mapInArrow(lambda it: _blocks(it, window), schema), "tree-suffixes")
    more = grow_subtrees(suffixes, rows).select(F.col("fp").alias("seg"), F.col("s").alias("from"), F.lit(1).alias("n"))
    return found.unionByName(more)


def _finished(batches: Iterator[pa.RecordBatch], window: int, keep: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(_DONE)
    for some in in_parts(batches):
        out = []
        for row in some:
            words = (row["text"] or "").encode().split()
            hits = [(x["s"], x["n"]) for x in row["found"] or ()]
            gone = covered(len(words), hits, window).tolist()
            kept = b" ".join([w for w, g in zip(words, gone, strict=True) if not g] if hits else words)
            text = kept.decode("utf-8", "replace") if keep else None
            done = (row["doc_id"], row["fp"], len(words), sum(gone), text, hashlib.sha256(kept).hexdigest())
            out.append(dict(zip(RESULT_NAMES, done, strict=True)))
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def remove_passages(
    df: DataFrame, length: int = 50, doc_id: str = "doc_id", text: str = "text", keep_text: bool = True, rows: int = SUBTREE_ROWS
) -> DataFrame:
    """Remove each word covered by ``length`` words that also start in a document with a smaller id.

    Words are runs of bytes other than blank, tab, line feed, vertical tab, form feed and
    carriage return, unchanged. Windows whose anchor (see ``anchors``) occurs in one document only
    cannot repeat and are left out. Stretches of windows with one anchor that are equal word for word are one string, which
    belongs to the smallest of its documents; the others lose it. The strings are grouped by the words at their
    anchors, the prefix of a suffix of each, and by longer prefixes where a group does not fit in memory;
    a suffix tree over each group gives the maximal repeats of ``length`` words and more, which say what
    the smallest documents lose to smaller ones (:func:`earlier_stretches`).

    Result: ``doc_id``, ``fp`` (a hash of the text), ``n_words``, ``n_removed``, the kept words joined by blanks ``kept`` (null
    if not ``keep_text``) and their SHA-256. A null text has no words. A row with a null id
    keeps all its words and is no source, because it has no place in the order; rows of
    the same id are one document. No rows give no rows. Only the two named columns are read.
    A text of 2^28 words or more is an error.
    """
    if length % BLOCKS:
        raise ValueError(f"length must be a multiple of {BLOCKS}")
    given = keyed(df, doc_id, text)
    sampled = written(repeated_stretches(given, length, True, True), "tree-sampled")
    segs = sampled.groupBy("h", "seg").agg(F.min("key").alias("least"), F.min(F.struct("key", "fp", "s", "n")).alias("one"))
    segs = written(segs, "tree-segs")
    grams = segs.groupBy("h").agg(F.min("least").alias("low"), F.max("least").alias("high"), F.sum("one.n").alias("size"))
    grams = written(grams.where("low < high").select("h", "size"), "tree-grams")
    standing = segs.join(grams, "h").select("one.key", "one.fp", F.struct("h", "seg", "least", "size", "one.s", "one.n").alias("x"))
    standing = standing.groupBy("key", "fp").agg(F.collect_list("x").alias("found"))
    pieces = (
        given.where(F.col("doc_id").isNotNull())
        .select("key", "fp", "text")
        .dropDuplicates(["key", "fp"])
        .join(standing, ["key", "fp"])
        .select("text", "found")
        .mapInArrow(lambda it: _pieces(it, length), PIECES)
    )
    pieces = written(pieces, "tree-pieces")
    runs = earlier_stretches(pieces, length, rows).withColumnsRenamed({"seg": "of", "n": "count"})
    known = segs.select("h", "seg", "least")
    members = written(sampled.join(known, ["h", "seg"]).select("key", "fp", "s", "n", "seg", (F.col("key") > F.col("least")).alias("later")), "tree-members")
    dropped(sampled)
    first = members.where("NOT later").join(runs, F.col("seg") == F.col("of"))
    hits = members.where("later").select("key", "fp", "s", "n").unionByName(
        first.select("key", "fp", (F.col("s") + F.col("from")).alias("s"), F.col("count").alias("n"))
    )
    found = hits.groupBy("key", "fp").agg(F.collect_set(F.struct("s", "n")).alias("found"))
    return (
        given.join(found, ["key", "fp"], "left")
        .select("doc_id", "fp", "text", "found")
        .mapInArrow(lambda it: _finished(it, length, keep_text), RESULT)
    )


def cut_passages(df: DataFrame, length: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, with all their columns, without what :func:`remove_passages` removes.

    A text that loses nothing stays as it is, as does that of a row with a null id; of the others the kept words are joined by
    blanks. Rows of which nothing is left are dropped, unless they had no words before. An
    ``n_chars`` column follows the new text. Repeated rows are cut each. Columns may have any names. No rows give no rows.
    """
    own, value = F.col(quoted(doc_id)).cast("long"), F.col(quoted(text)).cast("string")
    rows = df.select(
        F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("row"),
        own.alias("id"),
        fingerprint(own, value).alias("fp"),
    )
    # Rows without removed words are not joined: only the others' new texts are.
    cut = remove_passages(df, length, doc_id, text).where("n_removed > 0").dropDuplicates(["doc_id", "fp"])
    cut = written(cut.select(F.col("doc_id").alias("cut_id"), F.col("fp").alias("cut_fp"), "kept", "n_words", "n_removed"), "tree-cut")
    same = (F.col("id") == F.col("cut_id")) & (F.col("fp") == F.col("cut_fp"))
    joined = rows.join(cut, same, "left").where("n_removed IS NULL OR n_removed < n_words")
    out = []
    for name in df.columns:
        old = F.col("row").getField(name)
        if name == text:
            old = F.coalesce(F.col("kept"), old.cast("string"))
        elif name == "n_chars":
            kind = df.select(quoted(name)).schema[0].dataType
            old = F.when(F.col("kept").isNotNull(), F.length("kept").cast(kind)).otherwise(old)
        out.append(old.alias(name))
    return joined.select(*out)
