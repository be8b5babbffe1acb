import random
from collections import Counter

import pytest

from tallyframe import panel_flows, period_change
from tests.conftest import keyed


def test_change_over_a_gap_is_null(rows):
    df = rows("p int, est double", (1, 10.0), (3, 30.0), (4, 36.0), (5, 15.0))
    found = keyed(period_change(df, "est", "p"), "p")
    assert found[3]["change_prev"] is None
    assert found[4]["change_prev"] == 6.0
    assert found[4]["rel_prev"] == pytest.approx(0.2)
    assert found[5]["change_year"] == 5.0
    assert found[5]["rel_year"] == pytest.approx(0.5)


def test_groups_are_apart_and_zero_has_no_relative_change(rows):
    df = rows("g string, p int, est double", ("a", 1, 0.0), ("a", 2, 5.0), (None, 2, 1.0))
    found = keyed(period_change(df, "est", "p", "g"), "g", "p")
    assert found["a", 2]["change_prev"] == 5.0
    assert found["a", 2]["rel_prev"] is None
    assert found[None, 2]["change_prev"] is None


def test_other_season_length(rows):
    df = rows("p int, est double", (1, 10.0), (13, 30.0))
    found = keyed(period_change(df, "est", "p", season=12), "p")
    assert found[13]["change_year"] == 20.0


@pytest.mark.parametrize("repeat", [1, None])
def test_repeated_or_null_period_is_an_error(rows, repeat):
    df = rows("p int, est double", (1, 10.0), (repeat, 30.0))
    with pytest.raises(Exception, match="repeated or null period"):
        period_change(df, "est", "p").collect()


PANEL = "k string, p int, s string, w double"


def flows(df):
    found = panel_flows(df, "k", "p", "s", "w")
    keys = ("p", "kind", "from_state", "to_state")
    return {k: (v["n"], v["n_hat"]) for k, v in keyed(found, *keys).items()}


def brute_force(data):
    """Flows by looking each record's neighbours up in a dictionary."""
    seen = {(k, p): (s, w) for k, p, s, w in data if w and k is not None}
    count, total = Counter(), Counter()

    def add(key, w):
        count[key] += 1
        total[key] += w

    for k, p, s, w in data:
        if not w:
            continue
        before = seen.get((k, p - 1)) if k is not None else None
        if before:
            add((p, "stay", before[0], s), before[1])
        else:
            add((p, "entry", None, s), w)
        if k is None or (k, p + 1) not in seen:
            add((p + 1, "exit", s, None), w)
    return {key: (count[key], total[key]) for key in count}


def test_stay_entry_and_exit(rows):
    df = rows(PANEL, ("u", 1, "in", 2.0), ("u", 2, "out", 3.0), ("v", 2, "in", 5.0))
    assert flows(df) == {
        (1, "entry", None, "in"): (1, 2.0),
        (2, "stay", "in", "out"): (1, 2.0),
        (2, "entry", None, "in"): (1, 5.0),
        (3, "exit", "out", None): (1, 3.0),
        (3, "exit", "in", None): (1, 5.0),
    }


def test_null_key_is_never_linked(rows):
    df = rows(PANEL, (None, 1, "in", 2.0), (None, 2, "in", 3.0))
    found = flows(df)
    assert {kind for _, kind, _, _ in found} == {"entry", "exit"}
    assert sum(n for n, _ in found.values()) == 4


def test_repeated_key_is_an_error(rows):
    df = rows(PANEL, ("u", 1, "in", 2.0), ("u", 1, "out", 2.0))
    with pytest.raises(Exception, match="repeated panel key: k=u, p=1"):
        panel_flows(df, "k", "p", "s", "w").collect()


def test_null_period_is_an_error(rows):
    df = rows(PANEL, ("u", None, "in", 2.0))
    with pytest.raises(Exception, match="period column p is NULL"):
        panel_flows(df, "k", "p", "s", "w").collect()


def test_equals_brute_force_with_a_hot_and_a_null_key(rows):
    rng = random.Random(11)
    history = [p for p in range(-150, 400) if rng.random() < 0.9]
    data = [("hot", p, rng.choice(["a", "b", None]), 1.0) for p in history]
    for k in range(60):
        periods = rng.sample(range(-5, 140), 40)
        weights = [None, 0.0, 1.0, 2.0]
        data += [(f"k{k}", p, rng.choice("ab"), rng.choice(weights)) for p in periods]
    data += [(None, rng.randrange(140), "a", 1.0) for _ in range(1500)]
    assert flows(rows(PANEL, *data)) == brute_force(data)


def test_key_of_several_columns(rows):
    df = rows(
        "house int, person int, p int, s string, w double",
        (1, 1, 1, "in", 1.0),
        (1, 2, 2, "in", 1.0),
        (1, 1, 2, "out", 1.0),
        (1, None, 2, "in", 4.0),
    )
    second = panel_flows(df, ["house", "person"], "p", "s", "w").where("p = 2")
    found = keyed(second, "kind", "to_state")
    assert {k: v["n_hat"] for k, v in found.items()} == {("stay", "out"): 1.0, ("entry", "in"): 5.0}
