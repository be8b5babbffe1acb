"""Near-duplicates by circulant MinHash, banding and exact comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .anchors import Hashes, keyed
from .components import components
from .shared import dropped, written
from .text import BYTE_CODE, IS_SPACE, LOWER, fingerprint, mixed, quoted, run_hashes, texts, utf8, word_runs

#: A pair at the threshold of 0.75 is missed by all bands with a chance of 5 in a million.
BANDS, ROWS = 32, 4
#: Members of a bucket that are compared with one another in one task.
BLOCK = 128
#: Bands whose open buckets are compared first; what they link need not be compared again.
FIRST_BANDS = 4

SETS = "n long, cid long, bands array<long>"


def shingles(data: np.ndarray, bounds: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, lower-cased in A-Z: (hash, text), by text.

    A text with fewer words than ``size`` has one shingle, its words; one without words has none.
    """
    data = LOWER[data]
    starts, ends, _ = word_runs(data, bounds, ~IS_SPACE)
    own = np.searchsorted(starts, bounds)
    n = np.diff(own)
    hashes = Hashes(run_hashes(BYTE_CODE[data], starts, ends))
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), count)
    first = np.repeat(own[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    value = hashes.of(first, first + np.minimum(size, n)[doc])
    _, at = np.unique(mixed(value + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    at.sort()
    return value[at], doc[at]


def _permuted(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of the 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signatures(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Circulant MinHash: (set, coordinate) for sets that begin at ``first``.

    A first permutation scatters the shingles; each coordinate is the smallest value of a
    second one, shifted circularly by one more place each time.
    """
    scattered = _permuted((mixed(value) >> np.uint64(32)).astype(np.uint32) ^ np.uint32(0x5BD1E995))
    out = np.empty((len(first), BANDS * ROWS), np.uint32)
    for k in range(BANDS * ROWS):
        out[:, k] = np.minimum.reduceat(_permuted(scattered + np.uint32(k + 1)), first)
    return out


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, bounds in texts(batches, "text", 1 << 18):
        value, doc = shingles(data, bounds)
        n = np.bincount(doc, minlength=rows.num_rows)
        some = np.flatnonzero(n)
        cid, bands = np.zeros(rows.num_rows, np.int64), np.zeros((rows.num_rows, BANDS), np.int64)
        if len(some):
            first = (np.cumsum(n) - n)[some]
            cid[some] = mixed(np.add.reduceat(mixed(value), first) + n[some].astype(np.uint64)).view(np.int64)
            sign = signatures(value, first).reshape(len(some), BANDS, ROWS).astype(np.uint64)
            key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(some), BANDS))
            for r in range(ROWS):
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + sign[:, :, r])
            bands[some] = key.view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                *(rows.column(name) for name in ("doc_id", "key", "fp")),
                pa.array(n),
                pa.array(cid),
                pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel())),
            ],
            names=["doc_id", "key", "fp", "n", "cid", "bands"],
        )


def _alike(a: int, b: int, shared: int, percent: int) -> bool:
    return 100 * shared >= percent * (a + b - shared)


def _confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs whose full sets are alike."""
    for batch in batches:
        for low in range(0, batch.num_rows, 100):
            some = batch.slice(low, 100)
            sets = []
            for name in ("text_a", "text_b"):
                data, bounds = utf8(some.column(name))
                value, doc = shingles(data, bounds)
                cut = np.searchsorted(doc, np.arange(some.num_rows + 1))
                sets.append([value[cut[i] : cut[i + 1]] for i in range(some.num_rows)])
            keep = [
                _alike(len(a), len(b), len(np.intersect1d(a, b, assume_unique=True)), percent)
                for a, b in zip(*sets, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [some.column(name).filter(pa.array(keep, pa.bool_())) for name in ("a", "b")], names=["a", "b"]
            )


def _shared_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of all intersections of the left with the right sets."""
    sizes = np.array([len(s) for s in sets])
    member = np.repeat(np.arange(len(sets)), sizes)
    every, column = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(column, minlength=len(every)) > 1
    place = np.cumsum(often) - 1
    member, column = member[often[column]], place[column[often[column]]]
    order = np.argsort(column, kind="stable")
    member, column = member[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int(often.sum()), 8192):
        at = slice(*np.searchsorted(column, [low, low + 8192]))
        has = np.zeros((len(sets), 8192), np.float32)
        has[member[at], column[at] - low] = 1
        out += has[left] @ has[right].T
    return out


def _linked(table: pa.Table, percent: int) -> pa.Table:
    """Links between two blocks of a bucket, as many as it takes to connect their members."""
    kind, i, j = (table.column(name)[0].as_py() for name in ("kind", "i", "j"))
    major = table.column("major").to_numpy()
    cid = table.column("cid").to_numpy()
    component = table.column("component").to_numpy()
    block = table.column("block").to_numpy()
    data, bounds = utf8(table.column("text").combine_chunks())
    value, doc = shingles(data, bounds)
    cut = np.searchsorted(doc, np.arange(len(cid) + 1))
    sets = [value[cut[k] : cut[k + 1]] for k in range(len(cid))]
    left = np.flatnonzero(major if kind == 0 else block == i)
    right = np.flatnonzero(~major if kind == 0 else block == j)
    parent = {c: c for c in component.tolist()}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    a, b = [], []
    if len(left) and len(right):
        shared = _shared_counts(sets, left, right)
        sizes = np.array([len(s) for s in sets])
        union = sizes[left][:, None] + sizes[right][None, :] - shared
        near = (100 * shared >= percent * union) & (component[left][:, None] != component[right][None, :])
        for x, y in zip(*np.nonzero(near), strict=True):
            p, q = root(component[left[x]]), root(component[right[y]])
            if p != q:
                parent[p] = q
                a.append(cid[left[x]])
                b.append(cid[right[y]])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _open_buckets(entries: DataFrame, found: DataFrame) -> DataFrame:
    """Members of buckets of three and more whose members are not yet all connected.

    In a bucket of two, the pair has been compared. Buckets with the same members are
    one. ``major`` says who belongs to the bucket's largest component.
    """
    known = entries.join(found, F.col("cid") == F.col("node"), "left").select(
        "bk", "cid", F.coalesce("component", "cid").alias("component")
    )
    members = [F.xxhash64("cid"), F.xxhash64("cid", F.lit(1))]
    parts = known.groupBy("bk", "component").agg(
        F.count("*").alias("n"), *[F.bit_xor(m).alias(f"m{k}") for k, m in enumerate(members)]
    )
    sizes = parts.groupBy("bk").agg(
        F.sum("n").alias("size"),
        F.count("*").alias("n_components"),
        F.max(F.struct("n", "component")).alias("most"),
        *[F.bit_xor(f"m{k}").alias(f"m{k}") for k in range(2)],
    )
    chosen = sizes.where("size > 2 AND n_components > 1").groupBy("m0", "m1", "size").agg(F.min(F.struct("bk", "most")).alias("one"))
    chosen = chosen.select("one.bk", "size", F.col("one.most.n").alias("n_major"), F.col("one.most.component").alias("_major"))
    return known.join(chosen, "bk").withColumn("major", F.col("component") == F.col("_major")).drop("_major")


def _compared(entries: DataFrame, found: DataFrame, contents: DataFrame, percent: int) -> DataFrame:
    """Links of open buckets: all members outside the largest component with all others.

    Both are dealt to blocks. A block of the largest component meets each block of the rest
    (kind 0), and the blocks of the rest meet one another (kind 1). So a member of a bucket that
    is nearly connected is sent once.
    """
    n_major, n_rest = (F.ceil(n / BLOCK).cast("int") for n in (F.col("n_major"), F.col("size") - F.col("n_major")))
    own = F.when(F.col("major"), n_major).otherwise(n_rest)
    members = _open_buckets(entries, found).withColumn("block", F.pmod(F.xxhash64("cid", F.lit(7)), own).cast("int"))
    block = F.col("block")

    def tasks(kind: int, i, j) -> Column:
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))

    rest = F.sequence(F.lit(0), n_rest - 1)
    to_rest = F.transform(rest, lambda j: tasks(0, block, j))
    to_major = F.transform(F.sequence(F.lit(0), n_major - 1), lambda i: tasks(0, i, block))
    among = F.transform(rest, lambda j: tasks(1, F.least(block, j), F.greatest(block, j)))
    placed = members.withColumn("task", F.explode(F.when(F.col("major"), to_rest).otherwise(F.concat(to_major, among))))
    return (
        placed.select("bk", "cid", "component", "major", "block", "task.*")
        .join(contents, "cid")
        .select("bk", "kind", "i", "j", "cid", "component", "major", "block", "text")
        .groupBy("bk", "kind", "i", "j")
        .applyInArrow(lambda t: _linked(t, percent), "a long, b long")
    )


def near_duplicates(df: DataFrame, percent: int = 75, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents linked by alike sets of 5-word shingles, and what that connects.

    Documents with equal sets are one class, and only classes go on. Two classes are
    candidates if a band of their circulant MinHash signatures is equal. Every member of a
    bucket is first compared with one of them, on full sets; links make components. Only
    buckets whose members are still not all connected are then compared as a whole, in
    blocks of members, first those of a few bands and then the rest; what is connected
    already is not compared again, and a task returns no more links than connect its members. So a large group of copies costs one comparison for each,
    and no link between different texts is lost once a band has found it.

    Result: ``doc_id``, ``n_shingles``, ``component_id`` (the smallest id connected, itself
    included), ``kept`` (it is that one), ``fp`` (a hash of the text) and ``component`` (a number of the
    component, null for rows that are linked with nothing by rule). Texts that are null or
    have no words are linked with nothing. Rows with a null id are linked with nothing
    and kept, their component is null. Repeated rows are equal sets. No rows give no rows.
    Only the two named columns are read.
    """
    rows = keyed(df, doc_id, text)
    signed = written(
        rows.mapInArrow(_signed, "doc_id long, key long, fp long, " + SETS), "minhash-signed"
    )
    linkable = signed.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = written(
        linkable.groupBy("cid").agg(
            F.min(F.struct("key", "fp")).alias("first"), F.first("bands").alias("bands")
        ),
        "minhash-classes",
    )
    exploded = classes.select("cid", F.posexplode("bands").alias("band", "bk"))
    buckets = exploded.groupBy("bk").agg(F.count("*").alias("size"), F.min("cid").alias("center")).where("size > 1")
    entries = written(exploded.join(buckets, "bk"), "minhash-entries")
    pairs = written(
        entries.where("cid != center").select(F.col("center").alias("a"), F.col("cid").alias("b")).distinct(), "minhash-pairs"
    )
    wanted = entries.select("cid").distinct().join(classes, "cid").select("cid", "first.key", "first.fp")
    contents = written(
        rows.select("key", "fp", "text").join(wanted, ["key", "fp"]).select("cid", "text").dropDuplicates(["cid"]), "minhash-texts"
    )
    links = written(
        pairs.join(contents.select(F.col("cid").alias("a"), F.col("text").alias("text_a")), "a")
        .join(contents.select(F.col("cid").alias("b"), F.col("text").alias("text_b")), "b")
        .mapInArrow(lambda it: _confirmed(it, percent), "a long, b long"),
        "minhash-links",
    )
    dropped(pairs)
    found = components(links)
    for some in (entries.where(F.col("band") < FIRST_BANDS), entries):
        more = written(_compared(some.select("bk", "cid"), found, contents, percent), "minhash-more")
        if more.isEmpty():
            continue
        links = links.unionByName(more)
        found = components(links)
    least = (
        classes.select("cid", F.col("first.key").alias("id"))
        .join(found, F.col("cid") == F.col("node"), "left")
        .select("cid", "id", F.coalesce("component", "cid").alias("component"))
    )
    smallest = least.groupBy("component").agg(F.min("id").alias("component_id"))
    by_class = least.join(smallest, "component").select(F.col("cid").alias("_cid"), "component_id", "component")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    joined = signed.join(by_class, (F.col("cid") == F.col("_cid")) & ~alone, "left")
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
        "fp",
        "component",
    )


def keep_one(df: DataFrame, marked: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, with all its columns; ``marked`` is :func:`near_duplicates` of the rows.

    It is the row with the smallest id, and of rows that share the id the one with the
    smallest hash of its text. Rows with a null id or without words are linked with nothing, and stay.
    Repeated rows are one row. Columns may have any names. No rows give no rows.
    """
    own, value = F.col(quoted(doc_id)).cast("long"), F.col(quoted(text)).cast("string")
    linkable = own.isNotNull() & F.coalesce(value.rlike("[^\\x09-\\x0d\\x20]"), F.lit(False))
    kept = marked.where(F.col("component").isNotNull()).groupBy("component").agg(F.min(F.struct("doc_id", "fp")).alias("best"))
    # The columns given go in one struct, so that they clash with no name used here.
    rows = df.select(
        F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("row"),
        own.alias("id"),
        fingerprint(own, value).alias("fp"),
        linkable.alias("linkable"),
    )
    same = (F.col("id") == F.col("best.doc_id")) & (F.col("fp") == F.col("best.fp"))
    one = rows.where("linkable").join(kept.select("best"), same, "left_semi").dropDuplicates(["id", "fp"])
    return one.unionByName(rows.where("NOT linkable")).select(*[F.col("row").getField(c).alias(c) for c in df.columns])
