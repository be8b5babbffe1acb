"""Benchmark items in documents, found by templates; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import fingerprint, quoted

#: Words of a template window; shorter items are one window.
WINDOW = 12
#: Windows with fewer words that are no placeholders, and items with fewer words, must be equal
#: word for word, values included: their templates say too little.
FEWEST_LITERALS = 4
FEWEST_WORDS = 5
#: Words by which a window is found.
ANCHORS = 2
#: Anchors that are sent to every executor at once (about 200 bytes each); more are
#: sent in turns, each of which reads the documents.
BROADCAST_ANCHORS = 250_000
#: Windows of an item that a document must hold if values differ; one is enough word for word.
FEWEST_WINDOWS = 2
#: Share of an item's windows that a document must hold besides, at all distances together.
COVERAGE = 0.0

#: The placeholders' marks and a decimal point's, of a private area, and units that may follow a number.
NUMBER, NAME, UNIT, POINT = "\ue000", "\ue001", "\ue002", "\ue003"
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb oz ml l s sec min h hr hours minutes seconds days weeks months years "
    "percent degrees dollars euros pounds cents usd eur gbp meters metres kilometers kilometres miles feet inches "
    "grams kilograms liters litres"
).split()
#: What words are made of, in lower case: ASCII letters and digits, and all beyond but the blocks of punctuation
#: and what is punctuation among the wide and small forms.
WORD = (
    "a-z0-9\\u00c0-\\u1fff\\u2070-\\u2fff\\u3040-\\ufe0f\\ufe20-\\ufe2f\\ufe70-\\ufefe"
    "\\uff10-\\uff19\\uff21-\\uff3a\\uff41-\\uff5a\\uff66-\\x{10ffff}"
)


def _numbered(named: Column) -> Column:
    """The text with a mark before each number, and numbers apart from letters."""
    pointed = F.regexp_replace(named, "([0-9])[.,](?=[0-9])", "$1" + POINT)
    numbered = F.regexp_replace(pointed, f"([0-9][0-9{POINT}]*)", f" {NUMBER}$1 ")
    return F.regexp_replace(numbered, f"({NUMBER}[0-9{POINT}]+ ) ?%", "$1percent ")


def _plain(text: Column) -> Column:
    """The text without the characters that serve as marks."""
    marks = NUMBER + NAME + UNIT + POINT
    return F.when(text.rlike(f"[{marks}]"), F.translate(text, marks, "")).otherwise(F.coalesce(text, F.lit("")))


def _marked(text: Column) -> Column:
    """The text with a mark before each number, unit and name, then in lower case.

    A unit follows a number. A name is a word with a capital after a small letter or a comma
    and white space, so that the first word of a sentence is none. Texts without digits skip
    the steps for numbers.
    """
    named = F.regexp_replace(_plain(text), r"([\p{Ll},;][\s\p{Z}]+)(\p{Lu})", f"$1{NAME}$2")
    units = "|".join(sorted(UNITS, key=len, reverse=True))
    measured = F.regexp_replace(
        _numbered(named), f"({NUMBER}[0-9{POINT}]+ ) ?{NAME}?((?:{units}))(?![\\p{{L}}])", f"$1 {UNIT}$2"
    )
    return F.lower(F.when(text.rlike("[0-9]"), measured).otherwise(named))


def _split(marked: Column) -> Column:
    return F.array_remove(F.split(marked, f"[^{WORD}]+"), "")


def tokens(text: Column) -> Column:
    """Words, and placeholders that still hold their values."""
    return _split(_marked(text))


def plain_words(text: Column) -> Column:
    """The same words at the same places, without the marks of names and units."""
    plain = _plain(text)
    return _split(F.lower(F.when(text.rlike("[0-9]"), _numbered(plain)).otherwise(plain)))


def _is_slot(token: Column) -> Column:
    return token.rlike(f"^[{NUMBER}{NAME}{UNIT}]")


def _word(token: Column) -> Column:
    """The token as :func:`plain_words` has it."""
    return F.regexp_replace(token, f"^[{NAME}{UNIT}]", "")


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Compute a column before what uses it; else the optimizer puts it into each use."""
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def benchmark_items(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The items' words. Different texts under one id are ``variant`` s of the item.

    ``by_template`` says of each window whether it may be found with other values.
    """
    items = benchmark.select(F.col(quoted(item_id)).alias("item_id"), F.col(quoted(text)).cast("string").alias("words"))
    items = _once(items.where(F.col("item_id").isNotNull()), "words", tokens(F.col("words")))
    items = items.where(F.size("words") > 0).dropDuplicates()
    items = items.select(
        F.xxhash64("item_id", "words").alias("variant"),
        "item_id",
        F.col("words").alias("item_words"),
        F.least(F.size("words"), F.lit(WINDOW)).alias("length"),
    ).withColumn("n_item", F.size("item_words") - F.col("length") + 1)
    literals = lambda k: F.size(F.filter(F.slice("item_words", k + 1, F.col("length")), lambda t: ~_is_slot(t)))
    enough = lambda k: (F.size("item_words") >= FEWEST_WORDS) & (literals(k) >= FEWEST_LITERALS)
    return items.withColumn("by_template", F.transform(F.sequence(F.lit(0), F.col("n_item") - 1), enough))


def anchors(items: DataFrame) -> DataFrame:
    """The words to find the windows of an item by, and their places in the item.

    They are the longest words of each window, because long words are rare; of equally long
    ones the first in the alphabet. A window that is found by its template has its
    anchors among the words that are no placeholders, any other among all its words.
    """
    placed = items.select("variant", "item_words", "length", F.posexplode("by_template").alias("at", "free"))
    places = F.sequence(F.col("at"), F.col("at") + F.col("length") - 1)
    fixed = F.filter(places, lambda k: ~F.col("free") | ~_is_slot(F.get("item_words", k)))
    word = lambda k: _word(F.get("item_words", k))
    ranked = F.array_sort(
        F.transform(fixed, lambda k: F.struct((-F.length(word(k))).alias("rank"), word(k).alias("word"), k.alias("place")))
    )
    found = placed.select("variant", "length", F.explode(F.slice(ranked, 1, ANCHORS)).alias("a"))
    return found.select("variant", "length", F.col("a.word").alias("anchor"), F.col("a.place").alias("anchor_place")).distinct()


def _candidates(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(document, item, distance) where two anchors of the item are where they should be.

    An equal window always has its two; an item of one word has one.
    """
    # Only hashes of the words are broadcast, so the bytes follow the number of anchors.
    wanted = anchors(items).select("variant", "length", F.xxhash64("anchor").alias("anchor"), "anchor_place")
    turns = 1 + wanted.count() // BROADCAST_ANCHORS
    words = docs.select("doc_id", "fp", F.posexplode(plain_words(F.col("text"))).alias("place", "word"))
    counted = None
    for turn in range(turns):
        own = wanted if turns == 1 else wanted.where(F.pmod(F.col("variant"), F.lit(turns)) == turn)
        found = words.join(F.broadcast(own), F.xxhash64("word") == F.col("anchor"))
        found = found.groupBy("doc_id", "fp", "variant", (F.col("place") - F.col("anchor_place")).alias("distance")).agg(
            F.min("anchor_place").alias("low"), F.max("anchor_place").alias("high"), F.first("length").alias("length")
        )
        counted = found if counted is None else counted.unionByName(found)
    enough = counted.where((F.col("low") < F.col("high")) | (F.col("length") == 1))
    # Anchors are all words of an item of one or two: its first place is as good as all.
    apart = F.when(F.col("length") > ANCHORS, F.col("distance"))
    return enough.groupBy("doc_id", "fp", "variant", apart.alias("apart")).agg(F.min("distance").alias("distance")).drop("apart")


#: How two words match.
DIFFERENT, ALIKE, SAME = 0, 1, 2


def _match(item: Column, word: Column) -> Column:
    """Whether the words are the same but for case, or placeholders of one type; no word is different."""
    alike = _is_slot(item) & (F.substring(item, 1, 1) == F.substring(word, 1, 1))
    return F.when(_word(item) == _word(word), SAME).when(alike, ALIKE).otherwise(DIFFERENT)


def find_leaks(
    documents: DataFrame,
    benchmark: DataFrame,
    coverage: float = COVERAGE,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Benchmark items that documents hold, also with other numbers, names or units.

    Numbers, names and units become placeholders of their type; words that are the same but for
    case are equal even if only one of the texts shows them as names or units. Each window of an item's
    template is looked for by its two longest words: the documents' words are joined by hash with
    these, and grouped by item and distance, the place of the item's start in the
    document. Where two are found, the words there are compared with the item's
    template, window by window. Windows with fewer than four words that are no placeholders, and
    items of fewer than five words, are found only word for word, values included: a template of
    little else than placeholders fits anything. A window with other values must be consistent with
    the equal windows that overlap it: there, a value of the item stands for one value of the
    document. Two values of the item may stand for one. A leak is an item of which one window
    is found word for word, or two windows (all, if it has one) with other values; a share
    ``coverage`` of its windows may be asked for besides.
    Windows at several distances add up, so words may be put in or left out between them.
    ``reparameterised`` says that values were replaced wherever windows were found.

    Result: ``doc_id``, ``fp`` (a hash of the text, which tells rows of one id apart),
    ``item_id``, ``n_windows``, ``n_item`` (the item's windows), ``reparameterised`` and ``first_word``.
    A document that repeats an item has one row for it. An item of one word is in each document that
    has this word. An item without words is not looked for; a null text holds nothing; a null document id stays null; items without an id are left out;
    texts that share an item's id are variants of the item. Empty tables give no rows. Only the named
    columns are read.

    The anchors of the benchmark are broadcast, at most about ``BROADCAST_ANCHORS`` at once. Words
    are exploded without their document; the texts are shuffled once, to the candidates.
    """
    items = benchmark_items(benchmark, item_id, item_text)
    own, value = F.col(quoted(doc_id)).cast("long"), F.col(quoted(text)).cast("string")
    docs = documents.select(own.alias("doc_id"), fingerprint(own, value).alias("fp"), value.alias("text"))
    candidates = _candidates(docs, items)
    same = F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.fp") == F.col("c.fp"))
    met = docs.alias("d").join(candidates.alias("c"), same).select("d.*", "c.variant", "c.distance")
    met = met.join(items, "variant")
    kept = ["doc_id", "fp", "item_id", "variant", "distance", "length", "n_item", "item_words", "by_template"]
    # Only the words at the item's place go on, not the document's.
    there = F.transform(F.sequence(F.lit(0), F.size("item_words") - 1), lambda k: F.get("words", F.col("distance") + k))
    at_item = _once(met.select(*kept, tokens(F.col("text")).alias("words")), "words", F.col("words"))
    at_item = _once(at_item, "words", there)
    at_item = _once(at_item.withColumn("match", F.lit(None)), "match", F.zip_with("item_words", "words", _match))
    worst = lambda k: F.array_min(F.slice("match", k + 1, F.col("length")))
    windows = F.sequence(F.lit(0), F.col("n_item") - 1)
    verbatim = F.filter(windows, lambda k: worst(k) == SAME)
    equal = F.filter(windows, lambda k: (worst(k) == SAME) | ((worst(k) == ALIKE) & F.get("by_template", k)))
    at_item = _once(at_item.withColumn("verbatim", F.lit(None)), "verbatim", verbatim)
    at_item = _once(at_item.withColumn("equal", F.lit(None)), "equal", equal)
    in_window = lambda k: F.exists("equal", lambda e: (e <= k) & (k < e + F.col("length")))
    pair = lambda k: F.struct(_word(F.get("item_words", k)).alias("a"), _word(F.get("words", k)).alias("b"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.size("item_words") - 1),
        lambda k: F.when(_is_slot(F.get("item_words", k)) & in_window(k), pair(k)),
    )
    at_item = _once(at_item.withColumn("pairs", F.lit(None)), "pairs", pairs)
    # The values in a window and as many words on either side.
    low = lambda k: F.greatest(k - F.col("length") + 1, F.lit(0))
    around = lambda k: F.array_distinct(
        F.array_compact(F.slice("pairs", low(k) + 1, k + 2 * F.col("length") - 1 - low(k)))
    )
    one_each = lambda p: F.size(F.array_distinct(F.transform(p, lambda x: x["a"]))) == F.size(p)
    counted = F.filter("equal", lambda k: F.array_contains("verbatim", k) | one_each(around(k)))
    found = _once(at_item, "equal", counted)
    # Words put in or left out shift the rest: the windows of all distances add up.
    variants = found.where(F.size("equal") > 0).groupBy("doc_id", "fp", "item_id", "variant", "n_item").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("equal")))).alias("n_windows"),
        F.max(F.size("verbatim") > 0).alias("verbatim"),
        F.min(F.size("verbatim") < F.size("equal")).alias("reparameterised"),
        F.min(F.col("distance") + F.get("equal", F.lit(0))).alias("first_word"),
    )
    enough = F.col("verbatim") | (F.col("n_windows") >= F.least(F.lit(FEWEST_WINDOWS), F.col("n_item")))
    leaks = variants.where(enough & (F.col("n_windows") >= F.lit(coverage) * F.col("n_item")))
    return leaks.groupBy("doc_id", "fp", "item_id").agg(
        F.max("n_windows").alias("n_windows"),
        F.max("n_item").alias("n_item"),
        F.min("reparameterised").alias("reparameterised"),
        F.min("first_word").alias("first_word"),
    )


def drop_leaks(documents: DataFrame, leaks: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without a leak, with all their columns, which may have any names.

    Rows with a null id or text, and repeated rows, are judged as any others. No rows give no rows.
    """
    own, value = F.col(quoted(doc_id)).cast("long"), F.col(quoted(text)).cast("string")
    rows = documents.select(
        F.struct(*[F.col(quoted(c)) for c in documents.columns]).alias("row"), own.alias("id"), fingerprint(own, value).alias("fp")
    )
    found = leaks.select(F.col("doc_id").alias("leak_id"), F.col("fp").alias("leak_fp")).distinct()
    same = F.col("id").eqNullSafe(F.col("leak_id")) & (F.col("fp") == F.col("leak_fp"))
    kept = rows.join(found, same, "left_anti")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in documents.columns])
