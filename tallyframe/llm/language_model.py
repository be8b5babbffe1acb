"""Language-model scores: word pairs interpolated with words, by deleted interpolation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packed import squeeze, unsqueeze
from .shared import dropped, written
from .text import BYTE_CODE, IS_SPACE, LOWER, mixed, run_hashes, utf8, word_runs

#: What a text is used for: counted, counted and used to learn the weights, or scored only.
COUNTED, WEIGHED, SCORED = 0, 1, 2

#: Bytes of text in a block; a block's distinct n-grams are looked up once for all its texts.
BLOCK_BYTES = 4 << 20
#: Tokens for each range of n-grams whose counts are added up at once, at most.
PARTITION_TOKENS = 2_000_000
#: Lists of n-grams are merged, and cut into narrower ranges, by 2^FAN_BITS at a time.
FAN_BITS = 5
#: Contexts are put into buckets by the binary logarithm of their count.
BUCKETS = 41
#: Steps for one halving of a probability, and their largest number, in the held-out counts.
STEPS, LARGEST = 2, 100
EM_ROUNDS = 60

#: Bits of an n-gram's hash.
KEY_BITS = 56
_END, _START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)

BLOCKS = "block long, part int, n_docs long, n_tokens long, ids array<long>, lengths array<long>, text binary"
GRAMS = "w boolean, r long, member long, keys binary, marks binary"
UNITS = "w boolean, r long, g long, keys binary, marks binary, members array<long>, places array<binary>"
ANSWERS = "w boolean, r long, g long, p long, counts binary, v long"
SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Gather texts of one use into blocks; a block's number is its task's and its place there."""
    schema = pa.schema(
        [("block", pa.int64()), ("part", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]
        + [("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("text", pa.binary())]
    )
    task = TaskContext.get()
    number = (task.partitionId() if task else 0) << 32
    held: dict[int, list] = {}

    def flushed(part: int) -> pa.RecordBatch:
        nonlocal number
        ids, lengths, raw, n_tokens, _ = held.pop(part)
        number += 1
        packed = zstandard.ZstdCompressor(level=1).compress(b"".join(raw))
        row = [[number], [part], [len(ids)], [n_tokens], [ids], [lengths], [packed]]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    for batch in batches:
        data, bounds = utf8(batch.column("text"))
        ids, parts = batch.column("doc_id").to_pylist(), batch.column("part").to_pylist()
        cut = bounds.tolist()
        for i, part in enumerate(parts):
            raw = LOWER[data[cut[i] : cut[i + 1]]].tobytes()
            if part in held and held[part][4] + len(raw) > block_bytes:
                yield flushed(part)
            own = held.setdefault(part, [[], [], [], 0, 0])
            own[0].append(ids[i])
            own[1].append(len(raw))
            own[2].append(raw)
            own[3] += len(raw.split()) + 1
            own[4] += len(raw)
    for part in list(held):
        yield flushed(part)


def _tokens(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: each token's hash, its pair's hash, the token before it, and its text."""
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["text"]), np.uint8)
    bounds = np.concatenate([[0], np.cumsum(np.array(row["lengths"], np.int64))])
    starts, ends, doc = word_runs(data, bounds, ~IS_SPACE)
    docs = len(bounds) - 1
    at = np.searchsorted(doc, np.arange(docs), side="right")  # an end after each text's words
    words = np.insert(run_hashes(BYTE_CODE[data], starts, ends), at, _END)
    text = np.insert(doc, at, np.arange(docs))
    before = np.concatenate([[_START], words[:-1]])
    before[np.concatenate([[True], text[1:] != text[:-1]])] = _START
    shift = np.uint64(64 - KEY_BITS)
    pairs = mixed(before * np.uint64(0x9E3779B97F4A7C15) + words) >> shift
    return words >> shift, pairs, before >> shift, text


def _distinct(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """Sorted distinct n-grams of a block with their counts, and each token's two places among them."""
    words, pairs, before, text = _tokens(row)
    keys, place, counts = np.unique(np.concatenate([words, pairs]), return_inverse=True, return_counts=True)
    return keys, counts, place, (words, before, text)


def _pieces(keys: np.ndarray, marks: np.ndarray, bits: int) -> Iterator[tuple[int, bytes, bytes]]:
    """A sorted list cut by the first ``bits`` bits of its keys."""
    part = (keys >> np.uint64(KEY_BITS - bits)).astype(np.int64)
    first = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
    for a, b in zip(first, [*first[1:], len(part)], strict=True):
        yield int(part[a]), squeeze(np.diff(keys[a:b], prepend=np.uint64(0))), squeeze(marks[a:b])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_GRAMS = pa.schema([("w", pa.bool_()), ("r", pa.int64()), ("member", pa.int64()), ("keys", pa.binary()), ("marks", pa.binary())])
_ANSWERS = pa.schema(
    [("w", pa.bool_()), ("r", pa.int64()), ("g", pa.int64()), ("p", pa.int64()), ("counts", pa.binary()), ("v", pa.int64())]
)


def _asked(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The n-grams of each block, in ranges; a mark is twice the count, and one more for a word."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            keys, counts, place, (words, _, _) = _distinct(row)
            is_word = np.zeros(len(keys), np.uint64)
            is_word[place[: len(words)]] = 1
            marks = (counts.astype(np.uint64) << np.uint64(1)) * np.uint64(row["part"] != SCORED) | is_word
            yield _batch([(row["part"] == WEIGHED, r, row["block"], k, m) for r, k, m in _pieces(keys, marks, bits)], _GRAMS)


def _added(rows: list[dict]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Distinct keys of several lists, the place of each list's keys among them, which are words, and each list's counts."""
    keys = [np.cumsum(unsqueeze(r["keys"], np.uint64), dtype=np.uint64) for r in rows]
    marks = [unsqueeze(r["marks"], np.uint64) for r in rows]
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    is_word = np.zeros(len(every), dtype=bool)
    is_word[place[(np.concatenate(marks) & np.uint64(1)) == 1]] = True
    places = np.split(place, np.cumsum([len(k) for k in keys])[:-1])
    return every, places, is_word, [(m >> np.uint64(1)).astype(np.float64) for m in marks]


def _merged(table: pa.Table) -> pa.Table:
    """One list in place of the lists of a group of members, and where the members' n-grams are in it."""
    rows = table.to_pylist()
    every, places, is_word, counts = _added(rows)
    total = np.bincount(np.concatenate(places), np.concatenate(counts), len(every)).astype(np.uint64)
    out = {c: [rows[0][c]] for c in ("w", "r", "g")}
    out["keys"] = [squeeze(np.diff(every, prepend=np.uint64(0)))]
    out["marks"] = [squeeze(total << np.uint64(1) | is_word.astype(np.uint64))]
    out["members"] = [[r["member"] for r in rows]]
    out["places"] = [[squeeze(np.diff(at, prepend=0).astype(np.uint32)) for at in places]]
    return pa.table(out)


def _narrowed(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Merged lists cut into the ranges of the next level."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            keys = np.cumsum(unsqueeze(row["keys"], np.uint64), dtype=np.uint64)
            pieces = _pieces(keys, unsqueeze(row["marks"], np.uint64), bits)
            yield _batch([(row["w"], r, row["g"], k, m) for r, k, m in pieces], _GRAMS)


def _answered(table: pa.Table, step: int) -> pa.Table:
    """Corpus counts of the n-grams of one range, for each list in its own order, and the range's number of words.

    A list of texts that weights are learned from gets the counts of all such texts, too.
    """
    rows = table.to_pylist()
    every, places, is_word, counts = _added(rows)
    learned, weighed = np.zeros(len(every)), np.zeros(len(every))
    for r, at, count in zip(rows, places, counts, strict=True):
        learned[at] += count
        if r["w"]:
            weighed[at] += count
    here = rows[0]["r"]
    out = [(None, 0, 0, here, None, int((is_word & (learned > 0)).sum()))]
    for r, at in zip(rows, places, strict=True):
        both = [learned[at], weighed[at]] if r["w"] else [learned[at]]
        out.append((r["w"], here >> step, r["member"], here, squeeze(np.concatenate(both).astype(np.uint64)), 0))
    return pa.Table.from_batches([_batch(out, _ANSWERS)])


def _counts(row: dict, weighed: bool) -> np.ndarray:
    """The answers to a list, put together again; a second row has the counts of the weights' texts."""
    answers = sorted(row["answers"], key=lambda a: a["p"])
    return np.concatenate([unsqueeze(a["counts"], np.uint64).reshape(1 + weighed, -1) for a in answers], axis=1)


def _passed_on(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[pa.RecordBatch]:
    """The answers to a merged list, for each of its members."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            counts = _counts(row, row["w"])
            out = []
            for member, gaps in zip(row["members"], row["places"], strict=True):
                own = counts[:, np.cumsum(unsqueeze(gaps, np.uint32), dtype=np.int64)]
                out.append((row["w"], row["r"] >> step, member, row["r"], squeeze(own.ravel()), 0))
            yield _batch(out, _ANSWERS)


def _gathered(answers: DataFrame) -> DataFrame:
    return answers.where("w IS NOT NULL").groupBy("w", "r", "g").agg(F.collect_list(F.struct("p", "counts")).alias("answers"))


def _corpus_counts(blocks: DataFrame, n_blocks: tuple[int, int], parts: int) -> tuple[DataFrame, int]:
    """Answers to the blocks (``g`` is the block), and the number of distinct counted words.

    A tree: the lists of 2^FAN_BITS blocks are merged range by range, the merged lists are cut into
    ranges 2^FAN_BITS times as narrow and merged by as many again, and so on to ``parts`` ranges,
    each of which is added up at once. Each level exchanges at most 2^FAN_BITS rows for each block. The counts go back by the same way.
    """
    fan = 1 << FAN_BITS
    last = max(FAN_BITS, (parts - 1).bit_length())
    levels = max(2, -(-last // FAN_BITS))
    bits = [*(FAN_BITS * k for k in range(1, levels)), last]
    groups = F.when(F.col("w"), 1 + n_blocks[1] // fan).otherwise(1 + n_blocks[0] // fan)
    lists = blocks.mapInArrow(lambda it: _asked(it, bits[0]), GRAMS)
    lists = lists.withColumn("g", F.pmod(F.xxhash64("member"), groups.cast("long")))
    units = []
    for k in range(1, levels):
        units.append(written(lists.groupBy("w", "r", "g").applyInArrow(_merged, UNITS), f"model-units-{k}"))
        lists = units[-1].select("w", "g", "keys", "marks").mapInArrow(lambda it, own=bits[k]: _narrowed(it, own), GRAMS)
        lists = lists.withColumn("g", F.expr(f"member div {fan}"))
    step = bits[-1] - bits[-2]
    answers = written(lists.groupBy("r").applyInArrow(lambda t: _answered(t, step), ANSWERS), "model-counts")
    v = answers.where("w IS NULL").agg(F.sum("v")).first()[0] or 0
    for k in range(levels - 2, -1, -1):
        # A unit of the first level has blocks as members, which have all ranges.
        up = bits[k] - bits[k - 1] if k else bits[0]
        asked = units[k].select("w", "r", "g", "members", "places").join(_gathered(answers), ["w", "r", "g"])
        found = written(asked.mapInArrow(lambda it, own=up: _passed_on(it, own), ANSWERS), "model-answers")
        dropped(answers, units[k])
        answers = found
    return answers, v


def _looked_up(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each token of a block: counts of the word, the pair and the context; its text.

    The counts have two columns, the second being the share of the weights' texts.
    """
    keys, _, place, (words, before, text) = _distinct(row)
    own = np.zeros((len(keys), 2))
    got = _counts(row, row["part"] == WEIGHED)
    own[:, : len(got)] = got.T
    word, pair = own[place[: len(words)]], own[place[len(words) :]]
    # A word is a context as often as it occurs, and the start as often as the end.
    context = np.concatenate([word[:1], word[:-1]])
    shift = np.uint64(64 - KEY_BITS)
    first = before == _START >> shift
    end = own[np.searchsorted(keys, _END >> shift)]
    context[first] = end
    return word, pair, context, text


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(np.maximum(context, 0) + 1)), BUCKETS - 1).astype(np.int64)


def _step(p: np.ndarray) -> np.ndarray:
    """A probability on the scale of the held-out counts; the last step stands for zero."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(np.round(-STEPS * np.log2(p)), 0, LARGEST - 1), LARGEST).astype(np.int64)


def _held_out_counts(batches: Iterator[pa.RecordBatch], n: float) -> Iterator[pa.RecordBatch]:
    """How often a bucket meets probabilities of word and pair, by the counts without the block's part."""
    for batch in batches:
        for i in range(batch.num_rows):
            word, pair, context, _ = _looked_up(batch.slice(i, 1).to_pylist()[0])
            word, pair, context = (x[:, 0] - x[:, 1] for x in (word, pair, context))
            p2 = np.where(context > 0, pair / np.maximum(context, 1), 0)
            size = LARGEST + 1
            code = (_bucket(context) * size + _step(word / max(n, 1))) * size + _step(p2)
            found, count = np.unique(code, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(count.astype(np.int64))], names=["code", "count"])


def learn_weights(codes: np.ndarray, counts: np.ndarray, floor: float) -> np.ndarray:
    """Weights of floor, word and pair for each bucket, by expectation-maximisation.

    ``codes`` and ``counts`` are the held-out counts. A bucket without any keeps the start
    values; contexts that never occurred have no pair to weigh.
    """
    weights = np.tile([0.1, 0.45, 0.45], (BUCKETS, 1))
    weights[0] = [0.2, 0.8, 0.0]
    size = LARGEST + 1
    bucket, q1, q2 = codes // (size * size), codes // size % size, codes % size
    p = np.stack([np.full(len(codes), floor), np.exp2(-q1 / STEPS) * (q1 < LARGEST), np.exp2(-q2 / STEPS) * (q2 < LARGEST)])
    for _ in range(EM_ROUNDS if len(codes) else 0):
        share = weights[bucket].T * p
        share *= counts / share.sum(axis=0)
        total = np.stack([np.bincount(bucket, s, BUCKETS) for s in share], axis=1)
        seen = total.sum(axis=1) > 0
        weights[seen] = total[seen] / total[seen].sum(axis=1, keepdims=True)
    # The floor keeps some weight, so that every text has a probability.
    weights[:, 0] = np.maximum(weights[:, 0], 1e-6)
    return weights / weights.sum(axis=1, keepdims=True)


def _scores(batches: Iterator[pa.RecordBatch], weights: np.ndarray, n: int, v: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            word, pair, context, text = (x[:, 0] if x.ndim == 2 else x for x in _looked_up(row))
            w = weights[_bucket(context)]
            p = w[:, 0] / (v + 1) + w[:, 1] * word / max(n, 1) + w[:, 2] * pair / np.maximum(context, 1)
            docs = len(row["ids"])
            sums = [np.bincount(text, np.log10(x), docs) for x in ((word + 1) / (n + v + 1), p)]
            whole = [np.bincount(text, minlength=docs), np.bincount(text, word > 0, docs).astype(np.int64)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["ids"], pa.int64()), *map(pa.array, whole), *map(pa.array, sums)],
                names=["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )


def interpolated_scores(
    df: DataFrame,
    part: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    block_bytes: int = BLOCK_BYTES,
    partition_tokens: int = PARTITION_TOKENS,
) -> DataFrame:
    """Log10 probabilities of every whole text: ``doc_id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Tokens are words, lower-cased in A-Z, and an end. ``part`` says of each row whether it is
    counted (0), counted and used for the weights (1) or scored only (2 or null). The model
    mixes 1 / (V + 1), the word's share of all tokens, and the pair's share of its context,
    the word before; a context's count chooses the mixture. The mixtures are fitted to
    the texts of part 1 with counts from which that part is deleted, and then used with
    all counts. ``base_score`` is that of single words with one added to each count.

    How it is spread: texts are gathered into blocks, and each distinct n-gram of a block
    is one entry of a sorted list. Lists are cut by ranges of hashes and merged in a tree, 32 blocks
    and 32 ranges at a time, so that the rows exchanged grow with the blocks and their levels, and a frequent n-gram is one
    entry for 32 blocks, then for 1,024. The narrowest ranges, of which there is one for every ``partition_tokens``
    tokens, add up what the whole corpus sent; the counts go back through the tree, and the blocks, of ``block_bytes`` of text, meet their answers.

    A null text is empty, with the end as its only token; a null id stays null; repeated
    rows count each time; no rows give no rows. Other columns than ``doc_id``, ``text`` and
    those of ``part`` are not read. Differing n-grams share a count with the chance of equal
    56-bit hashes.
    """
    rows = df.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(part.cast("int"), F.lit(SCORED)).alias("part"),
        F.col(text).cast("string").alias("text"),
    )
    blocks = written(rows.mapInArrow(lambda it: _blocks(it, block_bytes), BLOCKS), "model-blocks")
    learned = F.when(F.col("part") != SCORED, F.col("n_tokens")).otherwise(0)
    weighed = F.when(F.col("part") == WEIGHED, F.col("n_tokens")).otherwise(0)
    sizes = [F.sum("n_tokens"), F.sum(learned), F.sum(weighed), F.count_if(F.col("part") != WEIGHED), F.count_if(F.col("part") == WEIGHED)]
    total, n, n_weighed, *n_blocks = (x or 0 for x in blocks.agg(*sizes).first())
    answers, v = _corpus_counts(blocks, tuple(n_blocks), 1 + total // partition_tokens)
    by_block = _gathered(answers).select(F.col("g").alias("block"), "answers")
    counts = (
        blocks.where(F.col("part") == WEIGHED)
        .join(by_block, "block")
        .mapInArrow(lambda it: _held_out_counts(it, n - n_weighed), "code long, count long")
        .groupBy("code")
        .agg(F.sum("count").alias("count"))
    )
    found = counts.toPandas()  # bounded by the number of codes
    weights = learn_weights(found["code"].to_numpy(np.int64), found["count"].to_numpy(float), 1 / (v + 1))
    scored = blocks.join(by_block, "block").mapInArrow(lambda it: _scores(it, weights, n, v), SCORES)
    return scored.withColumn("train_tokens", F.lit(n).cast("long"))
