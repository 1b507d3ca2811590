from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemill.functions import arrays, checks, convert, dates, json_access, numbers, strings


def values(spark, data, kind, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"i int, c {kind}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_strings(spark):
    go = lambda data, f: values(spark, data, "string", f)
    assert go(["  a \t b ", "   ", None], strings.collapse_whitespace("c")) == ["a b", "   ", None]
    assert go(["\u00a0a\u2003", "\t\n"], strings.trim("c")) == ["a", ""]
    assert go([" a ", None], strings.trim_start("c")) == ["a ", None]
    assert go([" a "], strings.trim_end("c")) == [" a"]
    assert go([None, "b", "ab"], strings.ensure_prefix("c", "a")) == [None, "ab", "ab"]
    assert go([None, "b", "ab"], strings.ensure_suffix("c", "b")) == [None, "b", "ab"]
    assert go(["a-b c1", "é٣_"], strings.remove_special_characters("c")) == ["abc1", "é٣"]
    assert go(["abc", None], strings.truncate("c", 0)) == ["", None]
    assert go(["a.b.c"], strings.replace("c", ".", "")) == ["abc"]
    assert go(["o'neil-foo BAR", "", None], strings.to_title_case("c")) == ["O'neil-Foo Bar", "", None]
    assert go([None, "", " ", "x"], strings.default_if_blank("c", "d")) == ["d", "d", "d", "x"]
    assert go([None, "", " "], strings.default_if_empty("c", "d")) == ["d", "d", " "]
    assert go([None, " ", "x"], strings.null_if_blank("c")) == [None, None, "x"]
    assert go(["a1b2é"], strings.remove_digits("c")) == ["abé"]
    assert go(["aé"], strings.remove_non_ascii("c")) == ["a"]
    with pytest.raises(ValueError):
        strings.truncate("c", -1)


def test_numbers(spark):
    assert values(spark, [3, 7, None], "int", numbers.at_least("c", 5)) == [5, 7, None]
    assert values(spark, [3, 7, None], "int", numbers.at_most("c", 5)) == [3, 5, None]
    assert values(spark, [3, 9, None], "int", numbers.clamp("c", 4, 8)) == [4, 8, None]
    assert values(spark, [Decimal("0.125"), Decimal("0.135")], "decimal(9,3)", numbers.round_half_even("c")) == [Decimal("0.12"), Decimal("0.14")]
    assert values(spark, [-3, 4, None], "int", numbers.zero_if_negative("c")) == [0, 4, None]
    assert values(spark, [1.5, -1.5], "double", numbers.floor("c")) == [1.0, -2.0]
    assert values(spark, [1.5, -1.5], "double", numbers.ceiling("c")) == [2.0, -1.0]
    assert values(spark, [0, 5], "int", numbers.default_if_zero("c", 9)) == [9, 5]
    with pytest.raises(ValueError):
        numbers.clamp("c", 2, 1)


def test_dates(spark):
    t = datetime(2024, 1, 3, 10, 29, 30)
    go = lambda f, x=t: values(spark, [x], "timestamp", f)[0]
    assert go(dates.truncate("c", timedelta(minutes=15))) == datetime(2024, 1, 3, 10, 15)
    assert go(dates.truncate("c", timedelta(days=7))) == datetime(2024, 1, 1)
    assert go(dates.round_to_minute("c")) == datetime(2024, 1, 3, 10, 30)
    assert go(dates.round_to_minute("c"), datetime(2024, 1, 1, 0, 0, 29, 999999)) == datetime(2024, 1, 1)
    assert go(dates.round_to_hour("c")) == datetime(2024, 1, 3, 10)
    assert go(dates.round_to_day("c"), datetime(2024, 1, 3, 12)) == datetime(2024, 1, 4)
    assert go(dates.default_if_null("c", datetime(2000, 1, 1)), None) == datetime(2000, 1, 1)
    with pytest.raises(ValueError):
        dates.truncate("c", timedelta(0))


def test_arrays(spark):
    go = lambda data, f: values(spark, data, "array<string>", f)
    assert go([["a", None, "a", ""], None], arrays.remove_nulls("c")) == [["a", "a", ""], None]
    assert go([["b", "a", "b"]], arrays.remove_duplicates("c")) == [["b", "a"]]
    assert go([["a", None, "", " "]], arrays.remove_empty("c")) == [["a", " "]]
    assert go([["a", None, "", " "]], arrays.remove_blank("c")) == [["a"]]
    assert go([["a", "b", "c"], ["a"]], arrays.skip("c", 2)) == [["c"], []]
    assert go([["a", "b", "c"], []], arrays.take("c", 2)) == [["a", "b"], []]
    assert go([["b", None, "a"]], arrays.sort("c")) == [[None, "a", "b"]]


def test_conversion(spark):
    data = [" 12 ", "1,234.5", "x", "", None, "-7", "1e2"]
    assert values(spark, data, "string", convert.to_int("c")) == [12, None, None, None, None, -7, None]
    assert values(spark, data, "string", convert.to_double("c")) == [12.0, 1234.5, None, None, None, -7.0, 100.0]
    assert values(spark, ["On", "0", "maybe", None], "string", convert.to_bool("c")) == [True, False, None, None]
    assert values(spark, ["red", "BLUE", "x"], "string", convert.to_enum("c", ["Red", "Blue"])) == ["Red", "Blue", None]
    assert values(spark, ["2024-01-02", "bad"], "string", convert.to_timestamp("c", "yyyy-MM-dd")) == [datetime(2024, 1, 2), None]
    assert values(spark, ["1", "x", None], "string", convert.failed("c", convert.to_int("c"))) == [False, True, True]
    assert values(spark, ["1,000.25"], "string", convert.to_decimal("c", 10, 2)) == [Decimal("1000.25")]


def test_null_rules(spark):
    """What each predicate says about null, and the empty string in the all-characters rules."""
    text = lambda f: values(spark, [None, ""], "string", f)
    assert text(checks.is_not_empty("c")) == [False, False]
    assert text(checks.is_not_blank("c")) == [False, False]
    for f in (checks.is_alphanumeric, checks.is_alphabetic, checks.is_digits_only):
        assert text(f("c")) == [True, True]
    for f in (checks.is_email, checks.is_guid, checks.is_url):
        assert text(f("c")) == [True, False]
    assert values(spark, ["abc\n"], "string", checks.is_alphabetic("c")) == [False]
    assert values(spark, ["a@b.c", "a@b", "a b@c.d"], "string", checks.is_email("c")) == [True, False, False]
    assert values(spark, ["0f8fad5b-d9cb-469f-a165-70867728950e", "{0f8fad5b-d9cb-469f-a165-70867728950e}", "0f8fad5b"], "string", checks.is_guid("c")) == [True, True, False]
    some = lambda f: values(spark, [None, [], [1, 1], [2]], "array<int>", f)
    assert some(checks.has_min_count("c", 1)) == [False, False, True, True]
    assert some(checks.has_max_count("c", 1)) == [False, True, False, True]
    assert some(checks.has_count_between("c", 0, 1)) == [True, True, False, True]
    assert some(checks.all_match("c", lambda x: x > 1)) == [False, True, False, True]
    assert some(checks.any_match("c", lambda x: x > 1)) == [False, False, False, True]
    assert some(checks.none_match("c", lambda x: x > 1)) == [True, True, True, False]
    assert some(checks.array_contains("c", 2)) == [False, False, False, True]
    assert some(checks.does_not_contain("c", 2)) == [True, True, True, False]
    assert some(checks.all_unique("c")) == [True, True, False, True]
    assert some(checks.is_subset_of("c", [1])) == [True, True, True, False]
    nan = float("nan")
    assert values(spark, [nan, 1.0, None], "double", checks.is_positive("c")) == [False, True, True]
    assert values(spark, [nan, float("inf"), 1.0], "double", checks.is_finite("c")) == [False, False, True]
    assert values(spark, [-3, 2], "int", checks.is_odd("c")) == [True, False]
    assert values(spark, [None], "int", checks.is_not_null("c")) == [False]


def test_json(spark):
    data = ['{"A": {"b": 5}, "n": null}', "no json", None]
    assert values(spark, data, "string", json_access.json_value("c", "A.b", "int")) == [5, None, None]
    assert values(spark, data, "string", json_access.json_value("c", "a.B", "int", ignore_case=True)) == [5, None, None]
    assert values(spark, data, "string", json_access.has_path("c", "n")) == [True, False, False]
    assert values(spark, data, "string", json_access.has_path("c", "A.b")) == [True, False, False]
    assert values(spark, data, "string", F.lit(1)) == [1, 1, 1]
