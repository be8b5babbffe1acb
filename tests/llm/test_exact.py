"""Operators against brute force, and their queries against SQL."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import (
    decontamination,
    language_model,
    minhash,
    packing,
    queries,
    suffix_array,
    suffix_tree,
)
from tallyframe.llm.components import components
from tallyframe.llm.text import run_hashes
from tests.compare import TESTDATA, database, difference

from . import brute

FOLDER = str(TESTDATA / "sf0.001")
TEXTS = "doc_id long, text string"


def documents(spark):
    return queries.table(spark, FOLDER, "documents").select("doc_id", "text")


def pairs(df):
    return [tuple(r) for r in df.collect()]


def mixed_texts(seed, n=60):
    """Texts that share passages in many ways: copies, edits, cuts, repeats within a text."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 7)))
    passages = [[word() for _ in range(rng.randint(40, 160))] for _ in range(6)]
    out = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 4)):
            part = list(rng.choice(passages))
            for _ in range(rng.choice([0, 0, 1, 3])):
                part[rng.randrange(len(part))] = word()
            low = rng.choice([0, 0, rng.randrange(20)])
            words += part[low:] + [word() for _ in range(rng.choice([0, 2, 60]))]
        out.append((i, rng.choice([" ", " ", "\n", "\t "]).join(words)))
    out.append((n, "x" * 900))
    out.append((n + 1, "ab" * 450))
    out.append((n + 2, " ".join(["same"] * 200)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_equal_brute_force(spark, rows, seed):
    given = mixed_texts(seed)
    found = suffix_tree.remove_passages(rows(TEXTS, *given)).collect()
    want = brute.passages(given)
    text = dict(given)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept.encode()) for r in found} == {i: want[i, text[i]] for i in text}
    assert sum(r.n_removed for r in found) > 0


@pytest.mark.parametrize("rows_in_memory", [1, 40])
def test_large_prefix_groups_are_split(spark, rows, rows_in_memory):
    """The same repeats come out of whole trees, of trees with longer prefixes, and without any."""
    rng = np.random.default_rng(5)
    blocks = rng.integers(0, 3, (600, suffix_tree.BLOCKS))
    key = rng.integers(0, 40, 600)
    given = [(*map(int, b), int(k), 0, i) for i, (b, k) in enumerate(zip(blocks, key, strict=True))]
    schema = ", ".join([*(f"b{k} long" for k in range(suffix_tree.BLOCKS)), "key long", "fp int", "s int"])
    found = {r.s for r in suffix_tree.grow_subtrees(rows(schema, *given), rows_in_memory).collect()}
    least = {}
    for b, k in zip(map(tuple, blocks), key, strict=True):
        least[b] = min(least.get(b, k), k)
    assert found == {i for i, (b, k) in enumerate(zip(map(tuple, blocks), key, strict=True)) if k > least[b]}


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_equal_brute_force(spark, rows, seed):
    given = mixed_texts(seed)
    found = suffix_array.remove_repeats(rows(TEXTS, *given)).collect()
    want = brute.repeats(given)
    text = dict(given)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found}
    assert got == {i: want[i, text[i]] for i in text}


def test_repeats_of_the_small_table(spark):
    given = pairs(documents(spark))
    want = brute.repeats(given)
    text = dict(given)
    found = queries.op7_suffix_array(spark, FOLDER).collect()
    assert {r.doc_id: tuple(r)[1:] for r in found} == {i: want[i, text[i]] for i in text}


def edited(seed, n, share):
    """Copies of one text that differ from it, and so from one another, in some words."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    out = []
    for i in range(n):
        words = list(base)
        for k in range(len(words)):
            if rng.random() < share:
                words[k] = f"v{rng.randrange(10**6)}"
        out.append((i, " ".join(words)))
    return out


@pytest.mark.parametrize("share", [0.01, 0.022, 0.03, 0.05])
def test_near_duplicates_equal_brute_force(spark, rows, share, monkeypatch):
    """Groups whose members are partly alike, so that one comparison for each is not enough."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    given = edited(3, 90, share)
    given += [(1000 + i, t) for i, t in edited(4, 20, 0.02)] + [(2000, given[0][1].upper()), (2001, "One two"), (2002, "one TWO")]
    found = minhash.near_duplicates(rows(TEXTS, *given)).collect()
    want = brute.near(given)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    assert {r.doc_id for r in found if r.kept} == {i for i, (_, c) in want.items() if i == c}


def test_components(spark, rows):
    rng = random.Random(9)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    found = {r.node: r.component for r in components(rows("a long, b long", *links)).collect()}
    parent = {x: x for link in links for x in link}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    assert found == {x: root(x) for link in links if link[0] != link[1] for x in link}


def test_language_model_base(spark):
    given = pairs(documents(spark))
    learned = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    want, n = brute.base_scores(given, learned)
    found = queries.op9_lm_scoring(spark, FOLDER).collect()
    assert len(found) == len(given)
    for r in found:
        tokens, known, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (tokens, known, n, not learned(r.doc_id))
        assert r.base_score == pytest.approx(score, rel=1e-9)
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_is_a_distribution(spark, rows):
    """Over the words after a context, with the unknown word, probabilities add up to one."""
    given = [(i, t) for i, t in enumerate(["a b a b", "a b c", "b a", "c c a b", "b"])]
    part = F.when(F.col("doc_id") == 4, 2).when(F.col("doc_id") == 3, 1).otherwise(0)
    probe = [(100 + i, f"a {w}") for i, w in enumerate(["a", "b", "c", "unknown"])] + [(200, "a")]
    df = rows(TEXTS, *given, *probe).withColumn("part", F.when(F.col("doc_id") >= 100, 2).otherwise(part))
    found = {r.doc_id: r.score for r in language_model.interpolated_scores(df, F.col("part")).collect()}
    # Both endings of "a w" differ only in the last factors, so compare the one-word text's end.
    assert all(score < 0 for score in found.values())
    assert found[101] > found[100]  # "a b" was seen, "a a" was not


def test_weights_are_learned():
    """Held-out pairs that agree with the pair's share put the weight there."""
    step = lambda p: int(round(-language_model.STEPS * np.log2(p)))
    size = language_model.LARGEST + 1
    code = (5 * size + step(1 / 1024)) * size + step(1 / 2)
    weights = language_model.learn_weights(np.array([code]), np.array([1000.0]), 1e-6)
    assert weights[5, 2] > 0.98
    assert weights.sum(axis=1) == pytest.approx(np.ones(language_model.BUCKETS))


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    odd = ["", "it's 12km O'Neill's", "<|endoftext|> a<|startoftext|>b", "ÉTÉ œuvre é İstanbul ΣΑΣ", "a b c\x1cd", "日本 語!!??"]
    given = pairs(documents(spark)) + [(10_000 + i, t) for i, t in enumerate([*odd, None, "word " * 9000])]
    df = spark.createDataFrame(given, TEXTS)
    pieces = {}
    for r in packing.pack_powers_of_two(df, queries.tokenizer_path()).collect():
        assert r.length & (r.length - 1) == 0 and r.length <= 4096 and r.length == 1 << r.bucket and r.offset == 0
        assert len(r.ids) == 4 * r.length
        pieces.setdefault(r.doc_id, []).append(r)
    numbers = [r.sequence_id for own in pieces.values() for r in own]
    assert len(set(numbers)) == len(numbers)
    for i, text in given:
        own = sorted(pieces[i], key=lambda r: r.start)
        want = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert np.frombuffer(b"".join(r.ids for r in own), "<u4").tolist() == want
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        assert {r.doc_tokens for r in own} == {len(want)}


def test_packing_query_sums(spark):
    found = queries.op4_packing(spark, FOLDER)
    whole = packing.pack_powers_of_two(documents(spark), queries.tokenizer_path())
    sums = {(r.doc_id, r.start): zlib.crc32(r.ids) for r in whole.collect()}
    assert {(r.doc_id, r.start): r.ids_crc32 for r in found.collect()} == sums


def test_leaks_equal_brute_force(spark):
    items = pairs(queries.table(spark, FOLDER, "benchmark").select("item_id", "text"))
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    # The first and last words of a passage may run into what stands around it.
    want = brute.held_items(pairs(documents(spark)), [(i, " ".join(words(t)[1:-1])) for i, t in items], words)
    found = queries.op10_decontamination(spark, FOLDER)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_reparameterised_questions(spark, rows):
    items = rows("item_id long, text string", (1, "If Anna has 12 apples and eats 3 kg of the 12 then how many does Anna keep today?"))
    docs = rows(
        TEXTS,
        (1, "Read on. If Bob has 20 apples and eats 7 lb of the 20 then how many does Bob keep today? Yes."),
        (2, "If Bob has 20 apples and eats 7 lb of the 21 then how many does Bob keep today?"),
        (3, "If Anna has 12 apples and eats 3 kg of the 12 then how many does Anna keep today?"),
        (4, "If Bob has 20 apples and eats all pears of the 20 then nobody does keep any today."),
        (5, "If Bob has 20 apples and eats 7 lb of the 20 then how many does Carl keep today?"),
    )
    found = {r.doc_id: r.reparameterised for r in decontamination.find_leaks(docs, items).collect()}
    assert found == {1: True, 3: False}


def leaks(rows, items, *texts):
    """(document, item) of the texts, numbered from 1, and of the items."""
    found = decontamination.find_leaks(
        rows(TEXTS, *enumerate(texts, 1)), rows("item_id long, text string", *enumerate(items, 1))
    )
    return {(r.doc_id, r.item_id) for r in found.collect()}


def test_items_of_few_literals_are_found_word_for_word(spark, rows):
    numbers = "so " + " ".join(f"{k} {k + 100} {k + 200} and" for k in range(101, 111)) + " nothing"
    items = ["What is 12 times 15?", "法国的首都是哪里？", "Name Paris.", numbers]
    found = leaks(
        rows,
        items,
        "Read on. What is 12 times 15? Yes.",
        "请回答。法国的首都是哪里？谢谢。",
        "Now name Paris, please.",
        "Well. So " + numbers[3:],
        "What is 12 times 16? Name Rome. 法国的首都是巴黎。 Paris name. " + numbers.replace("1", "2"),
    )
    assert found == {(1, 1), (2, 2), (3, 3), (4, 4)}


def test_passages_of_items_are_found(spark, rows):
    words = lambda name, n: [f"{name}{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(n)]
    short, long, broken = words("short", 59), words("long", 400), words("broken", 90)
    pieces = " well ".join(" ".join(broken[k : k + 15]) for k in range(0, 90, 15))
    found = leaks(
        rows,
        [" ".join(short), " ".join(long), " ".join(broken)],
        "He said: " + " ".join(short[20:45]) + " and left.",
        "He said: " + " ".join(long[200:300]) + " and left.",
        pieces,
        " ".join(short[:11]) + " and " + " ".join(long[:11]),
    )
    assert found == {(1, 1), (2, 2), (3, 3)}


def test_one_edited_value_does_not_hide_a_copy(spark, rows):
    item = (
        "A shop sells 12 pens to each of its first customers on every monday morning of the year and the owner "
        "then orders another 12 pens from the factory which lies behind the old town hall near the river"
    )
    values = "If Anna has 12 apples and eats 3 of them then how many apples does Anna keep for today?"
    found = leaks(
        rows,
        [item, values],
        item.replace("another 12", "another 15"),
        values.replace("12", "20").replace("3", "20"),
        values.replace("Anna keep", "Bob keep").replace("Anna has 12", "Carl has 20"),
    )
    assert found == {(1, 1), (2, 2)}


def test_case_and_line_ends_do_not_hide_a_copy(spark, rows):
    item = (
        "Wenn der Bauer auf dem Markt 5 Kilo von den Äpfeln an die Nachbarn gibt und der Rest im Keller "
        "bei den Kisten bleibt, wie viele Kilo hat der Bauer dann im Winter?"
    )
    other = item.replace("Bauer", "Koch").replace("Keller", "Schuppen").replace("Markt", "Platz")
    texts = [item.lower(), item.upper(), item.replace(" ", "\n"), item.replace(" ", "  "), other.replace(" ", "\n")]
    assert leaks(rows, [item], *texts) == {(k, 1) for k in range(1, 6)}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    found = queries.QUERIES[name](spark, FOLDER).toPandas()
    assert difference(found, database(FOLDER).sql(queries.ORACLE_SQL[name]).df()) is None


def test_hashes_follow_the_codes_alone():
    codes = np.random.default_rng(1).integers(0, 2**63, 100_000, dtype=np.uint64)
    again = np.concatenate([codes, codes])
    starts = np.array([0, 70_000, 99_990])
    ends = starts + 10
    assert (run_hashes(codes, starts, ends) == run_hashes(again, starts + 100_000, ends + 100_000)).all()


def test_maximal_repeats_are_the_deep_nodes():
    """A repeat longer than the window is one node, not one for each window; its parts are not maximal."""
    strings = [[f"w{k}".encode() for k in range(70)], [b"x", *(f"w{k}".encode() for k in range(4, 64)), b"y"]]
    number = {}
    codes = np.array([number.setdefault(w, len(number)) for s in strings for w in s])
    starts = np.concatenate([np.arange(21), 70 + np.arange(13)])
    ends = np.concatenate([np.full(21, 70), np.full(13, 132)])
    found = [(d, sorted(suffix.tolist()), len(set(node.tolist()))) for d, suffix, node in suffix_tree.maximal_repeats(codes, starts, ends, 50)]
    assert found == [(60, [4, 22], 1)]
    hit = suffix_tree.earlier_windows(strings, np.array([5, 3]), 50)
    assert np.flatnonzero(hit).tolist() == list(range(4, 15))
    hit = suffix_tree.earlier_windows(strings, np.array([3, 5]), 50)
    assert np.flatnonzero(hit).tolist() == list(range(22, 33))


@pytest.mark.parametrize("rows_in_memory", [1, 300])
def test_passages_with_longer_prefixes(spark, rows, rows_in_memory):
    """Groups that do not fit in memory give the same passages."""
    given = mixed_texts(3)
    found = suffix_tree.remove_passages(rows(TEXTS, *given), rows=rows_in_memory).collect()
    want, text = brute.passages(given), dict(given)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept.encode()) for r in found} == {i: want[i, text[i]] for i in text}


def test_ranks_number_the_sorted_strings(spark, rows):
    """Ranks over many ranges are those of one sorted list, also where a string goes over the end of a range."""
    rng = random.Random(6)
    given = [(k, k % 7, rng.choice([1, 2, 5, rng.randrange(10**6)]), rng.choice([0, 0, 9]), 5) for k in range(3000)]
    df = rows(suffix_array.PLACES, *given)
    found = suffix_array.ranked(df, "test-rank").collect()
    strings = sorted({g[2:4] for g in given})
    place = {x: k for k, x in enumerate(strings)}
    count = {}
    for g in given:
        count[g[2:4]] = count.get(g[2:4], 0) + 1
    want = {g[0]: (place[g[2:4]], 10 + (count[g[2:4]] == 1)) for g in given}
    assert {r.row: (r["rank"], r.mark) for r in found} == want


def test_rows_without_an_id_are_told_apart(spark, rows):
    """Many rows of one key, and the ids 0 and the smallest, beside rows without an id."""
    least = -(1 << 63)
    copy = " ".join(f"word{i}" for i in range(80))
    given = [(None, f"{k} {copy}") for k in range(40)] + [(0, copy), (least, copy), (5, copy), (5, f"other {copy}")]
    found = suffix_array.remove_repeats(rows(TEXTS, *given)).collect()
    want = brute.repeats(given)
    assert sorted((r.n_bytes, r.n_removed, r.kept_sha256) for r in found) == sorted(
        (want[g][0], want[g][1], want[g][3]) for g in given
    )
    cut = suffix_tree.remove_passages(rows(TEXTS, *given)).collect()
    assert sorted((r.doc_id, r.n_removed) for r in cut if r.doc_id is not None) == [(least, 0), (0, 80), (5, 80), (5, 80)]
    assert {r.n_removed for r in cut if r.doc_id is None} == {0}
    near = minhash.near_duplicates(rows(TEXTS, *given)).collect()
    assert {(r.doc_id, r.component_id) for r in near if r.doc_id is not None} == {(0, least), (least, least), (5, least)}
    assert {r.component_id for r in near if r.doc_id is None} == {None}
