"""Repeated strings found by ranking positions over growing lengths."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Hashes, in_parts, keyed, repeated_stretches, stretches
from .shared import dropped, read_from, written
from .text import BYTE_CODE, texts

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
#: A document that has open windows is carried on with its text; the others are finished.
CARRIED = RESULT + ", row long, text binary, open array<struct<s:int,n:int,w:int>>, hits array<struct<s:int,n:int>>"
_RESULT = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64())]
_RESULT += [("kept", pa.binary()), ("kept_sha256", pa.string())]


def _entries(lists: pa.Array) -> tuple[np.ndarray, ...]:
    """The row of each entry of a column of lists of structs, and the fields of the entries; a null list is empty."""
    each = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    fields = [flat.field(k).to_numpy(zero_copy_only=False) for k in range(flat.type.num_fields)]
    return np.repeat(np.arange(len(each)), each), *fields


def _listed(rows: int, own: np.ndarray, **fields: np.ndarray) -> pa.Array:
    """The opposite: a list for each row; ``own`` ascends."""
    offsets = np.searchsorted(own, np.arange(rows + 1)).astype(np.int32)
    entries = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in fields.values()], names=list(fields))
    return pa.ListArray.from_arrays(pa.array(offsets), entries)


def _finish(
    data: np.ndarray, bounds: np.ndarray, own: np.ndarray, s: np.ndarray, n: np.ndarray, window: int, keep: bool
) -> list[pa.Array]:
    """The columns of the result but the id, for texts that lose the windows ``s`` to ``s + n`` of the texts ``own``."""
    begin = bounds[own] + s
    edge = np.bincount(begin, minlength=len(data) + 1)
    edge -= np.bincount(begin + n - 1 + window, minlength=len(data) + 1)
    gone = np.cumsum(edge, out=edge)[:-1] > 0
    first = gone.copy()
    first[1:] &= ~gone[:-1]
    inner = bounds[1:-1][bounds[1:-1] < len(data)]
    first[inner] = gone[inner]
    spans = np.diff(np.searchsorted(np.flatnonzero(first), bounds))
    removed = np.zeros(len(spans), np.int64)
    for k in np.unique(own):
        removed[k] = np.count_nonzero(gone[bounds[k] : bounds[k + 1]])
    kept = [data[a:b][~gone[a:b]] if r else data[a:b] for a, b, r in zip(bounds, bounds[1:], removed, strict=False)]
    return [
        pa.array(np.diff(bounds)),
        pa.array(removed),
        pa.array(spans),
        pa.array([x.tobytes() for x in kept] if keep else [None] * len(kept), pa.binary()),
        pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
    ]


def _task() -> int:
    task = TaskContext.get()
    return task.partitionId() if task else 0


def _divided(batches: Iterator[pa.RecordBatch], window: int, keep: bool) -> Iterator[pa.RecordBatch]:
    """Finish the documents without open windows; number the others and pass them on."""
    schema = pa.schema(
        [*_RESULT, ("row", pa.int64()), ("text", pa.binary())]
        + [("open", pa.list_(pa.struct([("s", pa.int32()), ("n", pa.int32()), ("w", pa.int32())])))]
        + [("hits", pa.list_(pa.struct([("s", pa.int32()), ("n", pa.int32())])))]
    )
    number = _task() << 32
    for batch, data, bounds in texts(batches, "text"):
        own, s, n, w = _entries(batch.column("found"))
        undecided, hit = w != 0, w != 1
        waits = np.bincount(own[undecided], minlength=batch.num_rows) > 0
        # Texts that wait count as empty here, and the others where they are passed on.
        size = np.diff(bounds)
        done = np.concatenate([[0], np.cumsum(np.where(waits, 0, size))])
        at_once = hit & ~waits[own]
        finished = _finish(data[~np.repeat(waits, size)], done, own[at_once], s[at_once], n[at_once], window, keep)
        finished = [pc.if_else(pa.array(waits), pa.scalar(None, x.type), x) for x in finished]
        row = pa.array(number + np.cumsum(waits), pa.int64(), mask=~waits)
        number += int(waits.sum())
        text = [data[a:b].tobytes() if x else None for a, b, x in zip(bounds, bounds[1:], waits, strict=False)]
        later = undecided, hit & waits[own]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *finished, row, pa.array(text, pa.binary())]
            + [_listed(batch.num_rows, own[later[0]], s=s[later[0]], n=n[later[0]], w=w[later[0]])]
            + [_listed(batch.num_rows, own[later[1]], s=s[later[1]], n=n[later[1]])],
            schema=schema,
        )


def _ranges(rows: list[dict]) -> np.ndarray:
    return np.array([(x["s"], x["n"], x["w"]) for x in rows], np.int64).reshape(-1, 3)


def _narrowed(batches: Iterator[pa.RecordBatch], window: int, length: int) -> Iterator[pa.RecordBatch]:
    """Stretches of the open windows whose anchors are grams of ``length`` bytes."""
    for some in in_parts(batches):
        for row in some:
            text = np.frombuffer(row["text"], np.uint8)
            hashes = Hashes(BYTE_CODE[text])
            _, first, count, gram, _ = stretches(hashes, np.array([0, len(text)]), window, length)
            s, n, w = _ranges(row["open"]).T
            low = np.searchsorted(first, s, side="right") - 1
            each = np.searchsorted(first, s + n, side="left") - low
            of = np.repeat(np.arange(len(s)), each)
            at = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each) + low[of]
            begin = np.maximum(first[at], s[of])
            end = np.minimum(first[at] + count[at], (s + n)[of])
            h, seg, n, w = gram[at], hashes.of(begin, end - 1 + window), end - begin, w[of]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(seg.view(np.int64)), pa.array(np.full(len(h), row["row"]))]
                + [pa.array(x.astype(np.int32)) for x in (begin, n, w)],
                names=["h", "seg", "row", "s", "n", "w"],
            )


#: ``mark`` is 4 * w + o. ``o`` is the weight of the open window that starts at the place, 0 if none does; ``w`` is the
#: largest weight of the windows that the place is part of.
PLACES = "row long, s int, a long, b long, mark int"


def _table(row: np.ndarray, s: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, o: np.ndarray) -> pa.RecordBatch:
    columns = [row, s.astype(np.int32), a.astype(np.int64), b.astype(np.int64), (4 * w + o).astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["row", "s", "a", "b", "mark"])


def _first_places(batches: Iterator[pa.RecordBatch], window: int, length: int) -> Iterator[pa.RecordBatch]:
    """The places that open windows are made of, each with a name of the ``length`` bytes there."""
    for some in in_parts(batches):
        for row in some:
            hashes = Hashes(BYTE_CODE[np.frombuffer(row["text"], np.uint8)])
            weight = np.zeros(len(row["text"]) + 1, np.int32)
            for s, n, w in _ranges(row["open"]):
                weight[s : s + n] = np.maximum(weight[s : s + n], w)
            own = weight.copy()
            for k in range(length, window, length):
                own[k:] = np.maximum(own[k:], weight[:-k])
            s = np.flatnonzero(own)
            names = hashes.of(s, s + length).view(np.int64)
            yield _table(np.full(len(s), row["row"]), s, names, np.zeros(len(s)), own[s], weight[s])


#: What a range tells of itself: its number of strings, and its first and last string.
ENDS = (-1, -2, -3, -4, -5)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranks in a sorted partition: how many different strings stand before; ``mark`` is doubled, and one more if a string stands alone.

    The last rows, with the numbers of ``ENDS``, have in ``rank`` what the partition tells of itself.
    """
    part, begin = _task(), None
    carry = None  # the last row, whose successor is not known yet; whether its string is new; its rank
    names = ["part", "row", "s", "mark", "rank"]

    def rows(x: dict, rank: np.ndarray, alone: np.ndarray) -> pa.RecordBatch:
        columns = [np.full(len(rank), part, np.int32), x["row"], x["s"], 2 * x["mark"] + alone.astype(np.int32), rank]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        x = {c: batch.column(c).to_numpy() for c in ("row", "s", "a", "b", "mark")}
        if carry is None:
            begin = int(x["a"][0]), int(x["b"][0])
        else:
            x = {c: np.concatenate([carry[0][c], v]) for c, v in x.items()}
        n = len(x["a"])
        new = np.ones(n + 1, dtype=bool)
        new[1:n] = (x["a"][1:] != x["a"][:-1]) | (x["b"][1:] != x["b"][:-1])
        new[0] = carry is None or carry[1]
        rank = np.cumsum(new[:n]) - int(new[0]) + (0 if carry is None else carry[2])
        if n > 1:
            alone = new[:n] & new[1:] & (x["mark"] >> 2 == 1)
            yield rows({c: v[: n - 1] for c, v in x.items()}, rank[: n - 1], alone[: n - 1])
        carry = {c: v[n - 1 :] for c, v in x.items()}, bool(new[n - 1]), int(rank[-1])
    if carry is not None:
        x, new, rank = carry
        yield rows(x, np.array([rank]), np.array([new]) & (x["mark"] >> 2 == 1))
        none = {"row": np.array(ENDS, np.int64), "s": np.zeros(5, np.int32), "mark": np.zeros(5, np.int32)}
        yield rows(none, np.array([rank + 1, *begin, int(x["a"][0]), int(x["b"][0])]), np.zeros(5, dtype=bool))


def ranked(places: DataFrame, name: str) -> DataFrame:
    """(row, s, mark, rank) of each place: its rank among all strings (a, b); ``mark`` is doubled, and odd if no other place has its string.

    The places are sorted by ranges, so that a range may end within the places of one string; each
    range counts its strings, and the ranges' counts, five rows for each, tell what to add to its ranks.
    """
    order = ("a", "b", "row", "s")
    # Written first, because the ranges are found by a job of its own over the places.
    given = written(places, name)
    local = given.repartitionByRange(*order).sortWithinPartitions(*order)
    local = written(local.mapInArrow(_numbered, "part int, row long, s int, mark int, rank long"), name)
    dropped(given)
    told: dict[int, dict[int, int]] = {}
    for r in local.where("row < 0").select("part", "row", "rank").collect():
        told.setdefault(r["part"], {})[r["row"]] = r["rank"]
    ends = [(part, *(told[part][k] for k in ENDS)) for part in sorted(told)]
    moves, before = [], 0
    for k, (part, strings, *ab) in enumerate(ends):
        joined = k > 0 and list(ends[k - 1][4:]) == ab[:2]
        goes_on = k + 1 < len(ends) and list(ends[k + 1][2:4]) == ab[2:]
        before -= joined
        moves.append((part, before, 0 if joined else -1, strings - 1 if goes_on else -1))
        before += strings
    moves = places.sparkSession.createDataFrame(moves, "part int, before long, first long, last long")
    # As many rows as there are ranges.
    known = local.where("row >= 0").join(F.broadcast(moves), "part")
    alone = (F.col("mark") % 2 == 1) & (F.col("rank") != F.col("first")) & (F.col("rank") != F.col("last"))
    mark = F.col("mark") - F.col("mark") % 2 + alone.cast("int")
    return read_from(local, known.select("row", "s", mark.alias("mark"), (F.col("rank") + F.col("before")).alias("rank")))


def _by_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Sorted batches cut where a document ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        row = batch.column("row").to_numpy()
        cut = int(np.searchsorted(row, row[-1], side="left"))
        if held and held[-1].column("row")[-1].as_py() != row[0]:
            yield _columns(held)
            held = []
        if cut:
            yield _columns([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield _columns(held)


def _columns(batches: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    table = pa.Table.from_batches(batches)
    return {c: table.column(c).to_numpy() for c in table.column_names}


def _doubled(batches: Iterator[pa.RecordBatch], window: int, length: int) -> Iterator[pa.RecordBatch]:
    """Pairs of the ranks of a place and of the place ``length`` bytes on, for strings twice as long.

    Windows of which a place stands alone leave, and the places that only they needed.
    """
    for x in _by_rows(batches):
        number = np.cumsum(np.concatenate([[False], x["row"][1:] != x["row"][:-1]]))
        alone, o, w = x["mark"] & 1 == 1, x["mark"] >> 1 & 3, x["mark"] >> 3
        at = (number.astype(np.int64) << 32) | x["s"]
        starts = np.flatnonzero(o > 0)
        open_ = np.ones(len(starts), dtype=bool)
        for k in range(0, window, length):
            open_ &= ~alone[np.searchsorted(at, at[starts] + k)]
        starts = starts[open_]
        if not len(starts):
            continue
        wanted = np.unique(np.concatenate([at[starts] + k for k in range(0, window, 2 * length)]))
        here, on = np.searchsorted(at, wanted), np.searchsorted(at, wanted + length)
        own = np.zeros(len(at), np.int32)
        own[starts] = o[starts]
        weight = own[here] if 2 * length == window else w[here]
        yield _table(x["row"][here], x["s"][here], x["rank"][here], x["rank"][on], weight, own[here])


def repeated_windows(pending: DataFrame, window: int) -> DataFrame:
    """The open windows whose strings start elsewhere, too: (row, s), by prefix doubling.

    Places are ranked by a quarter of the length, then by the pairs of the ranks of their two
    halves, which is twice the length, and so on to the whole. After each round windows leave
    that have a place of which there is no second; weight 2 stands for a window that is known to repeat.
    """
    length = window // 4
    first = pending.select("row", "text", "open").mapInArrow(lambda it: _first_places(it, window, length), PLACES)
    ranks = ranked(first, f"array-rank-{length}")
    while length < window:
        sorted_rows = ranks.repartition("row").sortWithinPartitions("row", "s")
        pairs = sorted_rows.mapInArrow(lambda it, n=length: _doubled(it, window, n), PLACES)
        before, length = ranks, 2 * length
        ranks = ranked(pairs, f"array-rank-{length}")
        dropped(before)
    return ranks.where("mark % 2 = 0").select("row", "s", F.expr("mark div 2 % 4").alias("o"))


def _removed(batches: Iterator[pa.RecordBatch], window: int, keep: bool) -> Iterator[pa.RecordBatch]:
    for batch, data, bounds in texts(batches, "text"):
        own, s, n = (np.concatenate(x) for x in zip(*(_entries(batch.column(c)) for c in ("hits", "more")), strict=True))
        finished = _finish(data, bounds, own, s, n, window, keep)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *finished], schema=pa.schema(_RESULT))


def _judged(rows: DataFrame, *row: str) -> DataFrame:
    """Stretches of repeated grams: repeated whole (w = 0 or 2), or to be looked at (w = 1).

    ``weight`` is what a stretch counts: 2 if its windows are known to repeat. Of a
    stretch that repeats, one is looked at again (w = 2) if other stretches share its
    gram, because their windows may be its windows.
    """
    place = F.xxhash64(*row, "s")
    segs = rows.groupBy("h", "seg").agg(F.sum("weight").alias("n_seg"), F.min(place).alias("first"))
    grams = segs.groupBy("h").agg(F.sum("n_seg").alias("n_h"), F.min("n_seg").alias("least"))
    # Written, so that each join has two plain shuffles, whose large partitions Spark can split.
    grams = written(grams.where("n_h > 1").drop("n_h"), "array-grams")
    known = written(segs.join(grams, "h"), "array-known")
    weight = F.when(F.col("n_seg") == 1, F.lit(1)).when((F.col("least") == 1) & (place == F.col("first")), F.lit(2))
    return rows.join(known, ["h", "seg"]).select(*row, "s", "n", weight.otherwise(F.lit(0)).alias("w"))


def _lists(rows: DataFrame, name: str, row: list[str], *columns: str) -> DataFrame:
    """What was found of each document; its length is bounded by the document's."""
    return rows.groupBy(*row).agg(F.collect_set(F.struct(*columns)).alias(name))


def remove_repeats(
    df: DataFrame, length: int = 200, doc_id: str = "doc_id", text: str = "text", keep_text: bool = True
) -> DataFrame:
    """Remove each byte covered by a string of ``length`` bytes that starts anywhere else, too.

    Positions that cannot repeat are left out by sampled positions (see ``anchors``), whose grams of half
    the length and then of nineteen twentieths must repeat; sampled positions stand for stretches, and
    stretches that repeat whole are settled, which is what becomes of large groups of copies. The
    windows that are left are ranked by prefix doubling (:func:`repeated_windows`): Spark sorts
    pairs of ranks at growing offsets, and reranks until positions are unique or the length is reached.

    Result: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, the remaining bytes ``kept`` (null
    if not ``keep_text``) and their SHA-256. A null text is empty. Rows with a null id take part
    as any others. Repeated rows are strings that start elsewhere. Strings never cross
    rows. No rows give no rows. Only the two named columns are read. A text of 2^28 bytes or more is an error.
    """
    if length % 4:
        raise ValueError("length must be a multiple of four")
    rows = keyed(df, doc_id, text)
    sampled = written(repeated_stretches(rows, length, False, False).withColumn("weight", F.lit(1)), "array-sampled")
    found = _lists(_judged(sampled, "key", "fp"), "found", ["key", "fp"], "s", "n", "w")
    divided = written(
        rows.join(found, ["key", "fp"], "left")
        .select("doc_id", "text", "found")
        .mapInArrow(lambda it: _divided(it, length, keep_text), CARRIED),
        "array-divided",
    )
    dropped(sampled)
    pending = divided.where("row IS NOT NULL")
    names = "h long, seg long, row long, s int, n int, w int"
    narrowed = pending.select("row", "text", "open").mapInArrow(lambda it: _narrowed(it, length, length * 19 // 20), names)
    narrowed = written(narrowed.withColumn("weight", F.col("w")), "array-narrowed")
    judged = written(_judged(narrowed, "row"), "array-judged")
    dropped(narrowed)
    rest = _lists(judged.where("w > 0"), "open", ["row"], "s", "n", "w")
    single = repeated_windows(pending.select("row", "text").join(rest, "row"), length)
    single = single.where("o = 1").select("row", "s", F.lit(1).alias("n"))
    settled = judged.where("w != 1").select("row", "s", "n")
    more = _lists(settled.unionByName(single), "more", ["row"], "s", "n")
    finished = (
        pending.join(more, "row", "left")
        .select("doc_id", "text", "hits", "more")
        .mapInArrow(lambda it: _removed(it, length, keep_text), RESULT)
    )
    done = divided.where("row IS NULL").select(*finished.columns)
    return done.unionByName(finished)
