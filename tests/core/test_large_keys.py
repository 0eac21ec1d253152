"""Queries whose SQL once held constants that fit small tables only, on small tables with large keys."""

from __future__ import annotations

import duckdb
import pytest

from spindrift.plans import ORACLES, QUERIES

from .test_queries import plain

FOLDER = "/root/testdata/sf0.001"


def compared(spark, folder, name, made: dict[str, str]):
    """A query's rows and its SQL's over tables that ``made`` states over those of the smallest folder."""
    db = duckdb.connect()
    for table in ("customer", "supplier", "part", "orders", "lineitem", "nation"):
        text = made.get(table, "SELECT * FROM {}").format(f"'{FOLDER}/{table}.parquet'")
        path = f"{folder}/{table}.parquet"
        db.execute(f"COPY ({text}) TO '{path}' (FORMAT parquet)")
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    sql = db.sql(ORACLES[name])
    return plain(QUERIES[name](spark, str(folder)).select(*sql.columns).collect()), plain(sql.fetchall())


@pytest.mark.parametrize("name", ["flatten_reported_outcomes", "flatten_outcome_groups", "flatten_measurements", "flatten_analyses"])
def test_lines_of_large_parts_are_told_apart(spark, tmp_path, name):
    # Lines 2 of part 100003 and 3 of part 3: l_linenumber * 100000 + l_partkey is the same.
    lines = "SELECT * REPLACE (CAST(2 + l_linenumber % 2 AS INT) AS l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 100003 ELSE 3 END AS l_partkey) FROM {} WHERE l_orderkey < 200"
    parts = "SELECT * REPLACE (CASE WHEN p_partkey = 4 THEN 100003 ELSE p_partkey END AS p_partkey) FROM {}"
    mine, wanted = compared(spark, tmp_path, name, {"lineitem": lines, "part": parts})
    assert wanted and mine == wanted


def walk(k: int) -> list[int]:
    """The classes above a part's, as the tables derive them; none where it leaves the table."""
    out = [k]
    while k > 10:
        r = k % 100
        k = k + 1 if 40 <= r <= 58 or 60 <= r <= 88 else k - 19 if r == 59 else k // 3
        if r == 95 or k in out:
            return out
        out.append(k)
    return out


def test_class_rollup_has_no_bound_on_steps(spark, tmp_path):
    keys = max((walk(k) for k in range(1_500_000_060, 1_500_400_060, 100)), key=len)
    assert len(keys) > 152
    made = f"SELECT p.* REPLACE (CAST(k AS BIGINT) AS p_partkey) FROM (SELECT unnest({keys}) AS k), (SELECT * FROM {{}} LIMIT 1) p"
    mine, wanted = compared(spark, tmp_path, "class_rollup", {"part": made})
    assert mine == wanted and max(int(r[-1]) for r in mine) > 150


def test_effects_half_way_between_two_results(spark, tmp_path):
    """Effects like 0.0012345, in millilitres, whose binary digits lie on either side of the half."""
    each = "SELECT o.* REPLACE (CAST(3 AS BIGINT) AS o_orderkey, CAST(1 AS BIGINT) AS o_custkey, CAST(100250 AS DOUBLE) AS o_totalprice) FROM (SELECT * FROM {} LIMIT 1) o"
    mine, wanted = compared(spark, tmp_path, "analysis_distribution", {"orders": each})
    assert len(wanted) == 1 and mine == wanted


def test_effects_are_rounded_like_the_sql(spark, tmp_path):
    """Totals whose hundred-thousandths lie half way between two numbers of four decimals."""
    prices = [411185, 248485, 256125, 490755, 435955, 141925]
    each = f"SELECT o.* REPLACE (CAST(5 + 88 * i AS BIGINT) AS o_orderkey, CAST(4 + 60 * i AS BIGINT) AS o_custkey, CAST(p AS DOUBLE) AS o_totalprice) FROM (SELECT unnest({prices}) AS p, unnest(range(6)) AS i), (SELECT * FROM {{}} LIMIT 1) o"
    made = "SELECT * FROM (" + each + ")"
    mine, wanted = compared(spark, tmp_path, "analysis_distribution", {"orders": made})
    assert wanted and mine == wanted
