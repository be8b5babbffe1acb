from datetime import date
from decimal import Decimal

import pytest

from tallyframe import Field, malformed_counts, read_fixed_width
from tests.conftest import keyed

LAYOUT = [
    Field("id", 1, 4, "int"),
    Field("name", 5, 6),
    Field("weight", 11, 8, "decimal(6,2)"),
    Field("day", 19, 10, "date"),
]
LINES = [
    "   1Joana   12.50 2024-02-29",
    "   2João     7.25 2024-01-31",
    "    ",
    "   4Ana",
    "  x5Rui     1e99992024-02-30",
    "",
]


def read(spark, tmp_path):
    path = tmp_path / "sample.txt"
    path.write_text("\n".join(LINES) + "\n", encoding="utf-8")
    return read_fixed_width(spark, str(path), LAYOUT)


def test_fields_are_typed(spark, tmp_path):
    found = keyed(read(spark, tmp_path).where("id is not null"), "id")
    assert found[1] == {
        "name": "Joana", "weight": Decimal("12.50"), "day": date(2024, 2, 29), "malformed": [],
    }
    assert found[2]["name"] == "João"
    assert found[2]["weight"] == Decimal("7.25")


def test_blank_and_missing_fields_are_null_but_not_malformed(spark, tmp_path):
    found = read(spark, tmp_path).collect()
    assert len(found) == len(LINES)
    assert list(found[2]) == [None, None, None, None, []]
    assert list(found[3]) == [4, "Ana", None, None, []]
    assert list(found[5]) == [None, None, None, None, []]


def test_malformed_fields_are_null_and_counted(spark, tmp_path):
    df = read(spark, tmp_path)
    bad = df.where("name = 'Rui'").first()
    assert (bad.id, bad.weight, bad.day) == (None, None, None)
    assert bad.malformed == ["id", "weight", "day"]
    counts = keyed(malformed_counts(df), "field")
    assert {k: v["n_malformed"] for k, v in counts.items()} == {"id": 1, "weight": 1, "day": 1}


def test_only_the_fields_asked_for_are_cut(spark, tmp_path):
    plan = read(spark, tmp_path).select("id")._jdf.queryExecution().optimizedPlan().toString()
    assert "substring" in plan
    assert "decimal" not in plan


def test_single_byte_encoding(spark, tmp_path):
    path = tmp_path / "latin1.txt"
    path.write_text("\n".join(LINES) + "\n", encoding="latin-1")
    found = read_fixed_width(spark, str(path), LAYOUT, encoding="ISO-8859-1")
    assert found.exceptAll(read(spark, tmp_path)).count() == 0
    assert found.where("name = 'João'").first().weight == Decimal("7.25")


def test_several_files(spark, tmp_path):
    paths = []
    for i in (1, 2):
        path = tmp_path / f"{i}.txt"
        path.write_text(f"{i:>4}Ana\n")
        paths.append(str(path))
    found = read_fixed_width(spark, paths, LAYOUT)
    assert sorted(r.id for r in found.collect()) == [1, 2]


def test_values_that_would_be_rounded_or_cut_are_malformed(spark, tmp_path):
    layout = [Field("n", 1, 4, "int"), Field("x", 5, 8, "decimal(8,2)"), Field("t", 13, 4)]
    lines = ["   1  12.567abcd", "   2 12.5000abcd", "   3 1.25e1 abcd", "   41.2551e1abcd", "   5   99.00ab", "000", "   6  99"]
    path = tmp_path / "odd.txt"
    path.write_text("\n".join(lines) + "\n")
    found = [tuple(r) for r in read_fixed_width(spark, str(path), layout).collect()]
    assert found == [
        (1, None, "abcd", ["x"]),
        (2, Decimal("12.50"), "abcd", []),
        (3, Decimal("12.50"), "abcd", []),
        (4, None, "abcd", ["x"]),
        (5, Decimal("99.00"), "ab", []),
        (None, None, None, ["n"]),
        (6, None, None, ["x"]),
    ]


def test_zeros_and_blanks_after_the_digits_are_no_decimals(spark, tmp_path):
    layout = [Field("x", 1, 8, "decimal(8,2)"), Field("n", 9, 5, "decimal(5,0)")]
    lines = ["12.5000\t  7.0", "12.567\t   7.5", "     12.    .", "  -0.250   00", "  1.2.3     9"]
    path = tmp_path / "zeros.txt"
    path.write_text("\n".join(lines) + "\n")
    found = [tuple(r) for r in read_fixed_width(spark, str(path), layout).collect()]
    assert found == [
        (Decimal("12.50"), Decimal(7), []),
        (None, None, ["x", "n"]),
        (Decimal("12.00"), None, ["n"]),
        (Decimal("-0.25"), Decimal(0), []),
        (None, Decimal(9), ["x"]),
    ]


def test_unknown_encodings_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="windows-1252"):
        read_fixed_width(spark, str(tmp_path), LAYOUT, encoding="windows-1252")
