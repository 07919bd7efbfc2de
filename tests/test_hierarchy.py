"""Parents of intervals over whole groups."""

import random

from glossweave.operators.hierarchy import interval_parent, parent_by_level_scan, parent_by_level_stack

DDL = "grp string, start int, stop int, code string"


def brute(rows):
    out = {}
    for grp in {r[0] for r in rows}:
        before = []
        for _, a, b, code in sorted((r for r in rows if r[0] == grp), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is None, -(r[2] or 0), r[3])):
            whole = [x for x in before if None not in (x[0], x[1], a, b) and x[0] <= a and x[1] >= b]
            out[code] = whole[-1][2] if whole else None
            before.append((a, b, code))
    return out


def test_intervals(spark):
    r = random.Random(5)
    rows = []
    for i in range(900):
        a = r.randint(0, 50)
        rows.append((r.choice(["x", "y", None]), a, a + r.randint(0, 12), str(i)))
    rows += [("x", None, 5, "n1"), ("x", 3, None, "n2"), ("z", 1, 1, "alone")]
    got = {x.code: x.is_a for x in interval_parent(spark.createDataFrame(rows, DDL)).collect()}
    assert got == brute(rows)
    assert interval_parent(spark.createDataFrame([], DDL)).count() == 0


def test_large_group(spark):
    n = 20_000
    df = interval_parent(spark.range(n).selectExpr("'g' AS grp", "int(id) AS start", f"int({2 * n} - id) AS stop", "string(id) AS code"))
    # no row gathers the intervals before it
    assert "collect_list" not in df._jdf.queryExecution().toString()
    assert df.filter("is_a = string(start - 1) OR start = 0 AND is_a IS NULL").count() == n


def test_levels(spark):
    """Twenty levels, against the definition."""
    r = random.Random(8)
    rows = [(g, i, r.randint(1, 20) if i else 1, f"{g}{i}") for g in "ab" for i in range(150)] + [("c", 0, None, "c0"), ("c", 1, 2, "c1")]
    df = spark.createDataFrame(rows, "grp string, ord int, level int, code string")
    scan, stack = ({x.code: x.is_a for x in f(df).collect()} for f in (parent_by_level_scan, parent_by_level_stack))
    for g, i, level, code in rows:
        before = [x for x in rows if x[0] == g and x[1] < i and level and x[2]]
        up = [x[3] for x in before if x[2] == level - 1]
        lower = [x for x in before if x[2] < level]
        assert scan[code] == (up[-1] if up else None)
        assert stack[code] == (lower[-1][3] if lower and lower[-1][2] == level - 1 else None)
