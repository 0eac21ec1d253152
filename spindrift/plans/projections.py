"""Registry-shaped views of the test tables, as SQL that Spark and other engines read alike.

A study is an order, an arm a return flag, an outcome a line of an order, and so on; the texts in them are made
from the tables' own columns. ``lineitem`` repeats (l_orderkey, l_linenumber), so views take distinct rows
where they need a key.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import scratch

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS: dict[str, str] = {
    # One study for each order.
    "p_studies": """
SELECT 'NCT' || lpad(CAST(o_orderkey AS VARCHAR(20)), 8, '0') AS nct_id,
  CASE WHEN o_orderpriority LIKE '1%' THEN 'PHASE1' WHEN o_orderpriority LIKE '2%' THEN 'PHASE2' WHEN o_orderpriority LIKE '3%' THEN 'PHASE3'
       WHEN o_orderpriority LIKE '4%' THEN 'PHASE2/PHASE3' END AS phase,
  CAST(o_orderdate AS DATE) AS start_date, c_name AS organization,
  CASE o_orderstatus WHEN 'F' THEN 'RANDOMIZED' WHEN 'O' THEN 'NON_RANDOMIZED' END AS allocation,
  CASE o_orderstatus WHEN 'F' THEN 'Yes' WHEN 'O' THEN ' no ' ELSE 'unknown' END AS has_results_text,
  o_totalprice AS enrollment
FROM orders JOIN customer ON o_custkey = c_custkey""",
    # Planned and reported outcomes: distinct lines with texts of several shapes.
    "p_lines": """
SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus FROM lineitem""",
    "p_outcomes": """
SELECT 'NCT' || lpad(CAST(l_orderkey AS VARCHAR(20)), 8, '0') AS nct_id,
  CASE WHEN l_linenumber = 1 THEN 'Primary' WHEN l_linenumber <= 3 THEN 'secondary' ELSE 'OTHER' END AS outcome_type,
  CASE l_partkey % 9
    WHEN 0 THEN 'Change from baseline in ' || p_name || ' score (FEV1)'
    WHEN 1 THEN 'Proportion of participants with ' || p_name || ' response'
    WHEN 2 THEN 'Time to first ' || p_name || ' event'
    WHEN 3 THEN 'Overall  Survival' || chr(160) || '(OS)'
    WHEN 4 THEN 'Number of adverse events: ' || p_name
    WHEN 5 THEN 'Progression-free survival'
    WHEN 6 THEN 'Mean ' || p_type || ' volume in litres'
    WHEN 7 THEN 'Quality of life – ' || p_name || ' ' || chr(92) || '(total' || chr(92) || ')'
    ELSE p_name END AS measure,
  CASE l_linenumber % 7
    WHEN 0 THEN 'Baseline, Week ' || CAST(CAST(l_quantity AS INT) AS VARCHAR(9))
    WHEN 1 THEN 'Week ' || CAST(CAST(l_quantity AS INT) AS VARCHAR(9))
    WHEN 2 THEN 'Through Week ' || CAST(CAST(l_quantity AS INT) AS VARCHAR(9))
    WHEN 3 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR(9)) || ' months'
    WHEN 4 THEN 'Weeks 4, 8, and ' || CAST(CAST(l_quantity AS INT) AS VARCHAR(9))
    WHEN 5 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR(9)) || ' days following randomization'
    ELSE 'Baseline' END AS time_frame,
  CASE WHEN l_returnflag = 'R' THEN 'Higher scores mean a better outcome, at least ' || CAST(CAST(l_quantity AS INT) AS VARCHAR(9)) || '%' END AS description,
  CAST(l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey AS BIGINT) AS line_id
FROM p_lines JOIN part ON l_partkey = p_partkey""",
    "p_arms": """
SELECT DISTINCT 'NCT' || lpad(CAST(l_orderkey AS VARCHAR(20)), 8, '0') AS nct_id, 'Arm ' || l_returnflag AS title,
  CASE l_returnflag WHEN 'A' THEN 'Experimental' WHEN 'N' THEN 'Placebo Comparator' END AS group_type
FROM lineitem""",
    # Arm-level measurements: suppliers are endpoints, return flags arms, years time points.
    "p_groups": """
SELECT l_suppkey, l_returnflag, CAST(year(l_shipdate) AS INT) AS y, CAST(count(*) AS INT) AS n, round(avg(l_quantity), 6) AS mean,
  round(stddev_samp(l_quantity), 6) AS sd, min(l_quantity) AS lo, max(l_quantity) AS hi,
  percentile_cont(0.25) WITHIN GROUP (ORDER BY l_quantity) AS q1, percentile_cont(0.75) WITHIN GROUP (ORDER BY l_quantity) AS q3
FROM lineitem GROUP BY l_suppkey, l_returnflag, CAST(year(l_shipdate) AS INT)""",
    "p_measurements": """
SELECT 'NCT' || lpad(CAST(l_suppkey AS VARCHAR(20)), 8, '0') AS nct_id, 'Arm ' || l_returnflag AS group_title, CAST(y AS VARCHAR(9)) AS class_title,
  CASE (l_suppkey + y) % 5 WHEN 0 THEN 'Median' WHEN 1 THEN 'Least Squares Mean' WHEN 2 THEN 'NUMBER' ELSE 'Mean' END AS param_type,
  CASE (l_suppkey * 3 + y) % 10
    WHEN 0 THEN 'Standard Deviation' WHEN 1 THEN 'STANDARD_ERROR' WHEN 2 THEN '95% Confidence Interval' WHEN 3 THEN 'Inter-Quartile Range'
    WHEN 4 THEN 'Full Range' WHEN 5 THEN 'Geometric Coefficient of Variation' WHEN 6 THEN '90% Confidence Interval'
    WHEN 7 THEN 'Coefficient of Variation' WHEN 8 THEN 'Not Applicable' ELSE 'Spread' END AS dispersion_type,
  CASE (l_suppkey * 3 + y) % 10 WHEN 0 THEN sd WHEN 1 THEN round(sd / sqrt(n), 6) WHEN 5 THEN round(100 * sd / mean, 6) WHEN 7 THEN round(100 * sd / mean, 6) END AS dispersion_value,
  CASE (l_suppkey * 3 + y) % 10 WHEN 2 THEN mean - 2 WHEN 3 THEN q1 WHEN 4 THEN lo WHEN 6 THEN mean - 1.5 END AS lower_limit,
  CASE (l_suppkey * 3 + y) % 10 WHEN 2 THEN mean + 2 WHEN 3 THEN q3 WHEN 4 THEN hi WHEN 6 THEN mean + 1.5 END AS upper_limit,
  CASE WHEN (l_suppkey + y) % 11 = 0 THEN NULL ELSE n END AS n, mean AS param_value,
  CASE (l_suppkey + y) % 6 WHEN 0 THEN 'Liters (L)' WHEN 1 THEN 'mL' WHEN 2 THEN 'points on a scale' WHEN 3 THEN 'percent change' WHEN 4 THEN 'ML' ELSE 'furlongs' END AS unit_raw,
  CASE l_suppkey % 4 WHEN 0 THEN 'change_from_baseline' WHEN 1 THEN 'mean_value' WHEN 2 THEN 'proportion' ELSE 'time_to_event' END AS form_id,
  CASE WHEN l_suppkey % 3 = 0 THEN 'percent' END AS derivation_id,
  'measure_' || CAST(l_suppkey % 7 AS VARCHAR(9)) AS measurement_id,
  CASE y % 3 WHEN 0 THEN 'single_fixed' WHEN 1 THEN 'baseline_to_timepoint' END AS timepoint_pattern_id
FROM p_groups""",
    # Statistical analyses: customers with their orders by priority.
    "p_analyses": """
SELECT 'NCT' || lpad(CAST(o_custkey % 500 AS VARCHAR(20)), 8, '0') AS nct_id, CAST(o_orderkey AS BIGINT) AS analysis_id,
  CASE o_orderkey % 11 WHEN 0 THEN 'Hazard Ratio (HR)' WHEN 1 THEN 'Odds Ratio (OR)' WHEN 2 THEN 'Risk Ratio (RR)' WHEN 3 THEN 'Risk Difference (RD)' WHEN 4 THEN 'Rate Ratio'
    WHEN 5 THEN 'Mean Difference (Final Values)' WHEN 6 THEN 'Median Difference (Net)' WHEN 7 THEN 'Slope' WHEN 8 THEN 'Cox Proportional Hazard' WHEN 9 THEN 'Other [Cohen''s d]' END AS param_type,
  round(o_totalprice / 100000, 4) AS param_value_num,
  CASE o_orderkey % 8 WHEN 0 THEN '<0.001' WHEN 1 THEN '0.03' WHEN 2 THEN '= 0.5' WHEN 3 THEN ' <= .05 ' WHEN 4 THEN 'NS' WHEN 5 THEN '>0.1' WHEN 6 THEN '1e-4' END AS p_value,
  CASE WHEN o_orderkey % 5 = 0 THEN 'Yes' WHEN o_orderkey % 5 = 1 THEN 'false' END AS non_inferiority,
  CASE o_orderkey % 9 WHEN 0 THEN 'The non-inferiority margin was -100 mL' WHEN 1 THEN 'NI margin: 10%; observed difference 3%' WHEN 2 THEN 'margin of 5 or margin of 7'
    WHEN 3 THEN 'Margin 0.5 of the range' WHEN 4 THEN 'no number' END AS ni_description,
  CASE o_custkey % 4 WHEN 0 THEN 'change_from_baseline' WHEN 1 THEN 'mean_value' WHEN 2 THEN 'proportion' ELSE 'time_to_event' END AS form_id,
  CASE WHEN o_custkey % 3 = 0 THEN 'percent' END AS derivation_id,
  CASE o_custkey % 5 WHEN 0 THEN 'litre' WHEN 1 THEN 'millilitre' WHEN 2 THEN 'percent' END AS scale_id
FROM orders""",
    "p_interventions": """
SELECT DISTINCT 'NCT' || lpad(CAST(l_orderkey AS VARCHAR(20)), 8, '0') AS nct_id, CAST(l_linenumber AS INT) AS ordinal, p_type AS intervention_type, p_name AS name, p_brand AS other_name,
  'Arm ' || l_returnflag AS group_title
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    # Which studies belong to which areas and classes: by customer segment and by part.
    "p_study_ta": """
SELECT 'NCT' || lpad(CAST(o_orderkey AS VARCHAR(20)), 8, '0') AS nct_id, lower(c_mktsegment) AS ta_id, TRUE AS is_primary
FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL
SELECT 'NCT' || lpad(CAST(o_orderkey AS VARCHAR(20)), 8, '0'), 'region_' || CAST(n_regionkey AS VARCHAR(9)), FALSE
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "p_study_class": """
SELECT nct_id, class_id, kind, row_number() OVER (PARTITION BY nct_id ORDER BY min_size, class_id) = 1 AS is_primary
FROM (SELECT 'NCT' || lpad(CAST(l_orderkey AS VARCHAR(20)), 8, '0') AS nct_id, lower(p_type) AS class_id,
        CASE WHEN p_type = 'ECONOMY' THEN 'control' WHEN p_type = 'PROMO' THEN 'modality' ELSE 'pharmacologic' END AS kind, min(p_size) AS min_size
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3) x""",
}


def needed(names: str, made: tuple[str, ...] = ()) -> list[str]:
    """The views that a text names, and those that these name, each after what it needs; without those that stand as tables."""
    out: list[str] = []

    def add(text: str) -> None:
        for name in re.findall(r"\b[pd]_\w+\b", text):
            if name in VIEWS and name not in out and name not in made:
                add(VIEWS[name])
                if name not in out:
                    out.append(name)

    add(names)
    return out


RECURSIVE = "WITH RECURSIVE"
#: The mark of a further view of an oracle that its engine is to compute once.
ONCE = "/*materialized*/"


def reached_views(sql: str, extra: dict[str, str]) -> list[str]:
    """The further views that a text reaches, each after what it needs."""
    out: list[str] = []

    def add(text: str) -> None:
        for name in re.findall(r"\b[a-z]{1,2}_\w+\b", text):
            if name in extra and name not in out:
                add(extra[name])
                if name not in out:
                    out.append(name)

    add(sql)
    return out


def with_views(sql: str, more: dict[str, str] | None = None, made: tuple[str, ...] = ()) -> str:
    """``sql`` behind the views that it names, but those that stand as tables."""
    extra = more or {}
    used = reached_views(sql, extra)
    parts = [f"{n} AS ({VIEWS[n].strip()})" for n in needed(" ".join([*(extra[n] for n in used), sql]), made)]
    for n in used:
        text = extra[n].strip()
        parts.append(f"{n} AS MATERIALIZED ({text.removeprefix(ONCE)})" if text.startswith(ONCE) else f"{n} AS ({text})")
    text = sql.strip()
    if text.startswith(RECURSIVE):
        return f"{RECURSIVE} {', '.join([*parts, text.removeprefix(RECURSIVE).strip()])}"
    return (f"WITH {', '.join(parts)}\n" if parts else "") + text


#: What Spark runs for a part of a view: SQL's engine rounds the product with the power of ten, Spark the digits that a number is
#: written with, so that 4.11185 (4.111849999... in binary) would be 4.1119 there and 4.1118 here. Whole numbers are rounded alike.
SPARKS = {"round(o_totalprice / 100000, 4)": "round(o_totalprice / 100000 * 10000, 0) / 10000"}

_KEPT: dict[tuple, str] = {}


class Data:
    """The tables of a folder and the views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over the folder's tables, under view names of this library, so that a caller's views stay as they are."""
        for part, same in SPARKS.items():
            text = text.replace(part, same)
        named = re.compile(rf"\b(FROM|JOIN)\s+({'|'.join(TABLES)})\b")
        for name in {m[1] for m in named.findall(text)}:
            self.table(name).createOrReplaceTempView(f"spindrift_{name}")
        return self.spark.sql(named.sub(r"\1 spindrift_\2", text))

    def view(self, name: str, made: dict[str, DataFrame] | None = None) -> DataFrame:
        """A view; ``made`` are views below it that have been written, so that it reads them."""
        text = with_views(f"SELECT * FROM {name}", made=tuple(made or ()))
        for n, df in (made or {}).items():
            df.createOrReplaceTempView(f"spindrift_{n}")
            text = re.sub(rf"\b{n}\b", f"spindrift_{n}", text)
        return self.sql(text)

    def files(self) -> tuple:
        """Names, sizes and times of the folder's files: what is kept of a folder holds as long as they stay."""
        jvm, context = self.spark._jvm, self.spark.sparkContext
        path = jvm.org.apache.hadoop.fs.Path(self.sf_dir)
        found, out = path.getFileSystem(context._jsc.hadoopConfiguration()).listFiles(path, True), []
        while found.hasNext():
            file = found.next()
            out.append((str(file.getPath()), file.getLen(), file.getModificationTime()))
        return tuple(sorted(out))

    def kept(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table of the conform job, written once for each application and state of the folder, as later jobs read it many times."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, hash(self.files()), name)
        if key not in _KEPT:
            path = scratch(self.spark, name)
            build().write.parquet(path)
            _KEPT[key] = path
        return self.spark.read.parquet(_KEPT[key])
