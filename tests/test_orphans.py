from datetime import datetime as D
from datetime import timedelta

from reedbed.operators.orphans import COLUMNS, Link, Reference, find_orphans, orphan_report, stretches

T = "row_no long, made_at timestamp_ntz, ref int, extra string"
TARGET = "id int, added_at timestamp_ntz, removed_at timestamp_ntz, made_at string"


def found(spark, children, targets, **more):
    tables = {"child": spark.createDataFrame(children, T)}
    target = stretches(spark.createDataFrame(targets, TARGET), "id", "added_at", "removed_at")
    return find_orphans(tables, [Reference("child", "ref", "t")], {"t": target}, **more)


def test_kinds_and_periods(spark, rows):
    targets = [(1, None, None, "x"), (2, D(2031, 2, 1), D(2031, 3, 1), "x"), (2, D(2031, 5, 1), None, "x"), (2, D(2031, 5, 1), None, "x"), (3, None, D(2031, 1, 1), None), (4, D(2031, 2, 1), D(2031, 2, 1), None), (5, D(2031, 2, 2), D(2031, 2, 1), None)]
    children = [
        (1, D(2031, 1, 5), 1, "a"),
        (2, D(2031, 1, 5), 2, "a"),  # before every start
        (3, D(2031, 2, 1), 2, "a"),  # from the start on
        (4, D(2031, 3, 1), 2, "a"),  # no longer at the end
        (5, D(2031, 6, 1), 2, "a"),
        (6, D(2031, 6, 1), 9, "a"),
        (7, None, 9, None),
        (8, None, 2, None),
        (9, D(2031, 6, 1), None, None),
        (10, D(2031, 6, 1), 3, None),  # from the beginning, so never late
        (11, D(2030, 6, 1), 3, None),
        (12, D(2031, 6, 1), 4, None),  # its only stretch ends as it begins
        (13, D(2031, 6, 1), 5, None),  # its only stretch ends before it begins
        (6, D(2031, 6, 1), 9, "again"),
    ]
    assert rows(found(spark, children, targets).select(*COLUMNS)) == sorted(
        [
            ("child", 2, "ref", "2031-01", "late"),
            ("child", 4, "ref", "2031-03", "deleted"),
            ("child", 6, "ref", "2031-06", "missing"),
            ("child", 6, "ref", "2031-06", "missing"),
            ("child", 7, "ref", "unknown", "missing"),
            ("child", 10, "ref", "2031-06", "deleted"),
            ("child", 12, "ref", "2031-06", "deleted"),
            ("child", 13, "ref", "2031-06", "deleted"),
        ],
        key=repr,
    )


def test_empty_tables(spark, rows):
    assert rows(found(spark, [], [])) == []
    assert rows(found(spark, [], [(1, None, None, "x")])) == []
    assert [r[-2] for r in rows(found(spark, [(1, None, 1, "x")], []))] == ["missing"]


def test_empty_string_is_a_value(spark, rows):
    child = spark.createDataFrame([(1, D(2031, 1, 1), ""), (2, D(2031, 1, 1), "A"), (3, D(2031, 1, 1), None)], "row_no long, made_at timestamp_ntz, ref string")
    target = stretches(spark.createDataFrame([("a",)], "name string"), "name")
    got = find_orphans({"c": child}, [Reference("c", "ref", "t")], {"t": target})
    assert [(r.row_no, r.kind) for r in got.orderBy("row_no").collect()] == [(1, "missing"), (2, "missing")]


def test_cascade_follows_links_to_the_end_and_through_cycles(spark, rows):
    a = spark.createDataFrame([(1, None, 7, "k1", "z"), (2, None, 1, "k2", "z"), (3, None, 7, "k3", "z"), (4, None, 1, "k3", "z")], "row_no long, made_at timestamp_ntz, ref int, name string, up string")
    b = spark.createDataFrame([(1, None, "k1", "b1"), (2, None, "k2", "b2"), (3, None, "k3", "b3"), (4, None, None, "b4")], "row_no long, made_at timestamp_ntz, parent string, name string")
    c = spark.createDataFrame([(1, None, "b1", "c1"), (2, None, "b2", "c2")], "row_no long, made_at timestamp_ntz, parent string, name string")
    target = stretches(spark.createDataFrame([(1,)], "id int"), "id")
    links = [Link("b", "parent", "a", "name"), Link("c", "parent", "b", "name"), Link("b", "name", "c", "parent")]
    got = find_orphans({"a": a, "b": b, "c": c}, [Reference("a", "ref", "t")], {"t": target}, links)
    assert rows(got.select("table_name", "row_no", "field_name", "kind", "level")) == sorted(
        [("a", 1, "ref", "missing", 0), ("a", 3, "ref", "missing", 0), ("b", 1, "parent", "inherited", 1), ("c", 1, "parent", "inherited", 2), ("b", 1, "name", "inherited", 3)], key=repr
    )
    assert {(r.table_name, r.kind): r.orphans for r in orphan_report(got.where("level < 2")).collect()} == {("a", "missing"): 2, ("b", "inherited"): 1}


def test_hot_key(spark):
    target = [(1, D(2031, 1, 1), None, "x")] * 3000 + [(k, None, None, "x") for k in range(2, 50)]
    children = [(n, D(2030, 1, 1), 1, "x") for n in range(5000)]
    assert found(spark, children, target).groupBy("kind").count().collect() == [("late", 5000)]


def test_a_key_of_many_stretches(spark, rows):
    start = D(2031, 1, 1)
    day = lambda n: start + timedelta(days=n)
    target = [(1, day(4 * k), day(4 * k + 2), "x") for k in range(300)]
    children = [(n, day(n - 2), 1, "x") for n in range(400)]
    want = [("late" if n < 2 else "deleted", n) for n in range(400) if n < 2 or (n - 2) % 4 > 1]
    assert sorted((r.kind, r.row_no) for r in found(spark, children, target).collect()) == sorted(want)
