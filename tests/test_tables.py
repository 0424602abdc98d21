import pytest
from pyspark.sql import functions as F

from quirewise.errors import ConditionError, RequestError
from quirewise.functions.text import extension
from quirewise.operators import keys, tables
from quirewise.operators.tables import count_matching, drop_duplicates, filter_table, keep_first


def values(df, column="v"):
    return sorted((r[column] for r in df.collect()), key=repr)


def ids(df):
    return sorted(r["id"] for r in df.collect())


def cond(operator, value, column="v"):
    return {"column": column, "operator": operator, "value": value}


@pytest.fixture(scope="module")
def texts(spark):
    cells = [" Male ", "MALE", "male", None, "", "nan", "Female", "\u00a0Male\t"]
    return spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "id int, v string")


@pytest.mark.parametrize(
    "operator, value, expected",
    [
        ("==", "male", [0, 1, 2, 7]),
        ("==", "  MALE", [0, 1, 2, 7]),
        ("!=", "male", [3, 4, 5, 6]),
        ("contains", "male", [0, 1, 2, 6, 7]),
        ("contains", "^M", [0, 1, 2, 7]),
        ("contains", "na", [5]),
        ("==", "nan", [5]),
    ],
)
def test_text_mode(texts, operator, value, expected):
    assert ids(filter_table(texts, cond(operator, value), text_mode=True)) == expected


def test_contains_literal(spark):
    df = spark.createDataFrame([(1, "a.b"), (2, "axb")], "id int, v string")
    assert ids(filter_table(df, cond("contains", "a.b"), text_mode=True)) == [1, 2]
    assert ids(filter_table(df, cond("contains", "a.b"), text_mode=True, literal=True)) == [1]


@pytest.fixture(scope="module")
def numbers(spark):
    cells = [" 36 ", "36.0", "x", None, "NaN", "5d", "1e5", "-1", ".5", "+7", "0x10", "1_000"]
    return spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "id int, v string")


@pytest.mark.parametrize(
    "operator, value, expected",
    [
        (">", 5, [0, 1, 6, 9]),
        ("<=", "36", [0, 1, 7, 8, 9]),
        (">=", "36.0", [0, 1, 6]),
        ("<", 0, [7]),
        (">", -2.5, [0, 1, 6, 7, 8, 9]),
    ],
)
def test_numbers_in_text(numbers, operator, value, expected):
    assert ids(filter_table(numbers, cond(operator, value), text_mode=True)) == expected


@pytest.mark.parametrize("value", ["abc", "1e5", ""])
def test_bad_number_values_are_refused(numbers, value):
    with pytest.raises(ValueError, match="has to be a number"):
        filter_table(numbers, cond(">", value), text_mode=True)


def test_bad_patterns_are_refused(numbers):
    for text_mode in (True, False):
        with pytest.raises(ConditionError, match="no regular expression"):
            filter_table(numbers, cond("contains", "(a"), text_mode=text_mode)
        with pytest.raises(ConditionError, match="no regular expression"):  # one that only Python's engine takes
            filter_table(numbers, cond("contains", "(?P<n>a)"), text_mode=text_mode)
        assert filter_table(numbers, cond("contains", "(?<n>3)6"), text_mode=text_mode).count() > 0  # and one of the other kind


def test_unknown_operator(numbers):
    for text_mode in (True, False):
        with pytest.raises(ConditionError, match="cannot be compared|no operator"):
            filter_table(numbers, cond("~", "5"), text_mode=text_mode)


def test_condition_checks(spark):
    df = spark.createDataFrame([(0, False), (1, True)], "v int, b boolean")
    assert values(filter_table(df, cond("==", 0), text_mode=False)) == [0]
    assert filter_table(df, cond("==", False, "b"), text_mode=True).count() == 1
    for bad in ({"column": "v", "operator": "==", "value": None}, cond("", 1), cond("==", 1, "")):
        with pytest.raises(ConditionError, match="three parts"):
            filter_table(df, bad, text_mode=True)
    with pytest.raises(ConditionError, match="no column 'V'"):
        filter_table(df, cond("==", 1, "V"), text_mode=True)


def test_typed_mode(spark):
    df = spark.createDataFrame(
        [(1, 1.5, "a", "2024-01-02 00:00:00"), (2, float("nan"), " A", "2024-03-01 10:00:00"), (3, None, None, None)],
        "id int, f double, s string, t string",
    ).withColumn("t", F.col("t").cast("timestamp_ntz"))

    def run(*c):
        return ids(filter_table(df, [cond(*x) for x in c], text_mode=False))

    assert run((">", 1, "f")) == [1]
    assert run(("<", 2, "f")) == [1]
    assert run(("!=", "1.5", "f")) == [2, 3]
    assert run(("==", "a", "s")) == [1]
    assert run(("!=", "a", "s")) == [2, 3]
    assert run(("contains", "a", "s")) == [1, 2]
    assert run(("==", "2024-01-02", "t")) == [1]
    assert run((">", "2024-01-02", "t")) == [2]
    assert run(("!=", "2024-01-02", "t")) == [2, 3]
    assert run((">", 0, "f"), ("==", "a", "s")) == [1]
    assert run(("==", 5, "s")) == []
    assert run(("!=", 5, "s")) == [1, 2, 3]
    for bad in (("contains", "1", "id"), ("contains", "2024-01-02", "t"), ("==", "x", "id"), (">", "never", "t"), (">", 5, "s")):
        with pytest.raises(ConditionError):
            run(bad)


def test_typed_filter_is_pushed_into_the_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    df = filter_table(orders, cond(">=", "1998-01-02", "o_orderdate"), text_mode=False)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan


def test_conjunction_does_not_depend_on_order(spark):
    line = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    tests = [cond(">", "20", "l_quantity"), cond("==", "r", "l_returnflag")]
    first = filter_table(line, tests, text_mode=True).count()
    assert first == filter_table(line, tests[::-1], text_mode=True).count() > 0


def test_gender_is_normalised_in_text_mode(spark):
    df = spark.createDataFrame([(1, " Male"), (2, "FEMALE"), (3, None)], "id int, Gender string")
    out = filter_table(df, cond("!=", "x", "Gender"), text_mode=True)
    assert values(out, "Gender") == ["female", "male", None]
    assert values(filter_table(df, [], text_mode=False), "Gender") == [" Male", "FEMALE", None]


def test_counts_agree(texts):
    for mode in (True, False):
        count = count_matching(texts, "v", "MALE ", text_mode=mode).first()["Count"]
        assert count == filter_table(texts, cond("==", "male"), text_mode=True).count() == 4
    only = filter_table(texts, {**cond("!=", "male"), "count_only": True}, text_mode=True)
    assert only.columns == ["Count"] and only.first()["Count"] == 4
    with pytest.raises(ConditionError):
        count_matching(texts, "w", 1, text_mode=True)


def test_count_on_numbers(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,)], "v double")
    assert count_matching(df, "v", "2.0", text_mode=False).first()["Count"] == 1
    with pytest.raises(ConditionError):
        count_matching(df, "v", "two", text_mode=False)


def test_keep_first_wins_whatever_the_partitioning(spark):
    rows = [(k, i, f"x{i}") for i, k in enumerate([1, 2, 1, None, 2, None, 1] * 50)]
    df = spark.createDataFrame(rows, "k int, pos int, x string").repartition(7)
    out = drop_duplicates(df, ["k"], "pos")
    assert sorted((r["k"] or 0, r["pos"], r["x"]) for r in out.collect()) == [(0, 3, "x3"), (1, 0, "x0"), (2, 1, "x1")]
    assert drop_duplicates(out, ["k"], "pos").count() == 3
    with pytest.raises(RequestError):
        drop_duplicates(df, ["k"])
    with pytest.raises(RequestError):
        drop_duplicates(df, ["nope"], "pos")


def test_keep_first_limits_groups_before_the_shuffle(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 2)
    plan = keep_first(df, ["k"], "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_empty_condition_list_still_drops_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, None)], "id int, v string")
    assert filter_table(df, [], text_mode=True).count() == 4
    assert filter_table(df, [], text_mode=True, dedup=True).count() == 2
    assert filter_table(df, [], text_mode=True, dedup=True, count_only=True).first()["Count"] == 2
    with pytest.raises(RequestError):
        filter_table(df, [], text_mode=True, columns=["nope"])


def test_distinct_values_keep_order_and_missing(spark):
    df = spark.createDataFrame([(5, "b"), (1, None), (2, "b"), (3, "a")], "pos int, v string")
    assert [r["value"] for r in tables.distinct_values(df, "v", "pos").collect()] == [None, "b", "a"]


def test_table_text_blocks_join_to_the_whole(spark):
    df = spark.createDataFrame([(i, f"n{i}" if i else None) for i in range(10)], "row_no int, v string").repartition(4)
    blocks = tables.table_to_text(df, "row_no", ["v"], block_rows=4).orderBy("block_no").collect()
    assert len(blocks) == 3
    assert "\n".join(b["text"] for b in blocks) == "\n".join(["NaN"] + [f"n{i}" for i in range(1, 10)])


def test_column_widths(spark):
    df = spark.createDataFrame([("a", None), ("abcdef", None)], "v string, long_name string")
    assert {r["column_name"]: r["width"] for r in tables.column_widths(df).collect()} == {"v": 8, "long_name": 11}


def test_is_empty_and_json(spark):
    assert tables.is_empty(spark.range(0)) and not tables.is_empty(spark.range(1))
    df = spark.createDataFrame([(1, None)], "id int, v string")
    assert tables.result_as_json(df).first()["json"] == '{"id":1,"v":null}'


@pytest.mark.parametrize(
    "name, expected",
    [("a.TXT", ".txt"), ("x/y.tar.gz", ".gz"), (".bashrc", ""), ("plain", ""), ("a.b/c", ""), ("end.", "."), ("..a", "")],
)
def test_extension(spark, name, expected):
    assert spark.range(1).select(extension(F.lit(name)).alias("e")).first()["e"] == expected


# ---- keys ----------------------------------------------------------------------------------


def test_insert_if_absent(spark):
    store = spark.createDataFrame([("a",)], "k string")
    batch = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("c", 4), (None, 5)], "k string, n int")
    errors = {r["n"]: r["error"] for r in keys.insert_if_absent(store, batch, ["k"], ["n"]).collect()}
    assert errors[2] is None and errors[4] is None
    assert errors[1] == "key already stored" and errors[3] == "key repeated in this batch" and errors[5] == "missing key"


def test_delete_keys_reports_missing(spark):
    store = spark.createDataFrame([(1,), (2,), (2,)], "id int")
    kept, missing = keys.delete_keys(store, spark.createDataFrame([(2,), (9,), (9,)], "id int"), ["id"])
    assert ids(kept) == [1] and ids(missing) == [9]


def test_bag_difference_spreads_and_keeps_counts(spark):
    left = spark.createDataFrame([("hot",)] * 1000 + [("a",)] * 2 + [("b",)], "v string")
    right = spark.createDataFrame([("hot",)] * 3 + [("b",)] * 2 + [("absent",)], "v string")
    out = keys.bag_difference(left, right, chunk=100)
    assert {r["v"]: r["count"] for r in out.groupBy("v").count().collect()} == {"hot": 997, "a": 2}


def test_find_and_own(spark):
    df = spark.createDataFrame([(2, "u", "f"), (1, "u", "f"), (3, "w", "f")], "id int, user_id string, name string")
    assert keys.find_first(df, {"name": "f", "user_id": "u"}, ["id"]).first()["id"] == 1
    assert ids(keys.owned_by(df, "u")) == [1, 2]
    assert ids(keys.in_files(df, [1, 3], "id")) == [1, 3] and ids(keys.in_files(df, None, "id")) == [1, 2, 3]
