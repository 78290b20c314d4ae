"""Filter / sort / page requests over the session table.

A request has the grid widget's shape::

    {"filterModel": {col: cond | {"operator": "AND"|"OR", "condition1": c1, "condition2": c2}},
     "sortModel": [{"colId": col, "sort": "asc"|"desc"}, ...],
     "startRow": a, "endRow": b}

Conditions on several columns are a conjunction.  ``OR`` is a boolean OR
(the reference concatenated both sides, so rows matching both came twice).
Filter text is cast to the column's type (P24).  ``contains`` takes a regex,
as the reference, or plain text with ``"literal": True``.  Negated tests (notEqual, notContains, notStartsWith,
notEndsWith) keep null cells, like pandas ``ne``; the others drop them.  An
unknown column or test raises instead of being skipped silently.

Sorting puts nulls last in both directions (pandas) and always ends with the
grid's base order, newest first (connectTime desc, dcosId desc), so pages are
deterministic.  A page near the start is ``orderBy().offset(a).limit(b - a)``:
Spark plans a top-(b) per task and merges, never a full sort into one task.

A deep page, and one without an end, would pass all rows before it, or behind
it, through one task.  For these there is an order-statistics index
(:class:`PageIndex`): the filtered rows dealt into ranges of the sort order, as
folders, with the count of each.  Running counts say which ranges a page
touches; only their folders are read, and rows are numbered within a range.  One
index serves all pages, and the row count, of a request.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadcurve.session import scratch_path

HIDDEN_COLUMNS = ("userId", "finishChargeTime", "true_peakPower_W", "Overstay_s", "Overstay_h",
                  "Overstay_total_h")
BASE_ORDER = (("connectTime", "desc"), ("dcosId", "desc"))

_COMPARE = {
    "equals": lambda c, a: c == a,
    "notEqual": lambda c, a: c != a,
    "lessThan": lambda c, a: c < a,
    "lessThanOrEqual": lambda c, a: c <= a,
    "greaterThan": lambda c, a: c > a,
    "greaterThanOrEqual": lambda c, a: c >= a,
}
_TEXT = {
    "contains": lambda c, a: c.rlike(a),
    "notContains": lambda c, a: ~c.rlike(a),
    "startsWith": lambda c, a: c.startswith(a),
    "notStartsWith": lambda c, a: ~c.startswith(a),
    "endsWith": lambda c, a: c.endswith(a),
    "notEndsWith": lambda c, a: ~c.endswith(a),
}
_LITERAL = {   # with ``"literal": True`` the text stands for itself
    "contains": lambda c, a: c.contains(a),
    "notContains": lambda c, a: ~c.contains(a),
}
_KEEPS_NULLS = {"notEqual", "notContains", "notStartsWith", "notEndsWith"}


def grid_table(sessions: DataFrame) -> DataFrame:
    return sessions.drop(*[c for c in HIDDEN_COLUMNS if c in sessions.columns])


def condition(df: DataFrame, col: str, cond: dict) -> Column:
    if col not in df.columns:
        raise ValueError(f"unknown column {col!r}")
    dtype = df.schema[col].dataType
    c = F.col(col)
    typ = cond.get("type")
    date = cond.get("filterType") == "date"
    a = cond.get("dateFrom" if date else "filter")
    literal = bool(cond.get("literal"))
    b = cond.get("dateTo" if date else "filterTo")
    if typ == "blank":
        return c.isNull()
    if typ == "notBlank":
        return c.isNotNull()
    if typ in _TEXT:
        test = (_LITERAL if literal and typ in _LITERAL else _TEXT)[typ](c.cast("string"), str(a))
    elif typ in _COMPARE:
        test = _COMPARE[typ](c, F.lit(a).cast(dtype))
    elif typ == "inRange":
        test = c.between(F.lit(a).cast(dtype), F.lit(b).cast(dtype))
    else:
        raise ValueError(f"unknown filter type {typ!r}")
    return F.coalesce(test, F.lit(typ in _KEEPS_NULLS))


def filter_predicate(df: DataFrame, filter_model: dict) -> Column:
    pred = F.lit(True)
    for col, spec in (filter_model or {}).items():
        if "operator" in spec:
            c1, c2 = condition(df, col, spec["condition1"]), condition(df, col, spec["condition2"])
            op = spec["operator"].upper()
            if op not in ("AND", "OR"):
                raise ValueError(f"unknown operator {op!r}")
            term = (c1 & c2) if op == "AND" else (c1 | c2)
        else:
            term = condition(df, col, spec)
        pred = pred & term
    return pred


def apply_filters(df: DataFrame, filter_model: dict) -> DataFrame:
    return df.filter(filter_predicate(df, filter_model)) if filter_model else df


def sort_columns(df: DataFrame, sort_model: list | None) -> list[Column]:
    keys, seen = [], set()
    for s in list(sort_model or []) + [{"colId": c, "sort": d} for c, d in BASE_ORDER]:
        col, d = s["colId"], s.get("sort", "asc")
        if col not in df.columns:
            raise ValueError(f"unknown column {col!r}")
        if col in seen:
            continue
        seen.add(col)
        keys.append(F.col(col).asc_nulls_last() if d == "asc" else F.col(col).desc_nulls_last())
    return keys


@dataclass
class GridResult:
    rows: DataFrame        # the requested page
    row_count: DataFrame   # one row: rowCount of the filtered table


SHALLOW_ROWS = 10_000        # pages that end up to here are taken from the top of each task
ROWS_PER_RANGE = 1_000_000   # rows of an index range: what one task sorts
MOST_RANGES = 10_000         # ranges of an index, whose counts the driver holds


class PageIndex:
    """Ranges of a request's sort order, written under ``path``, and their counts; ``schema`` is the table's."""

    def __init__(self, spark: SparkSession, path: str, request: dict, schema: T.StructType):
        self.path, self.sort_model = path, request.get("sortModel")
        self.table = spark.read.schema(T.StructType([*schema.fields, T.StructField("_range", T.IntegerType())])).parquet(path)
        counts = self.table.groupBy("_range").agg(F.count("*").alias("n")).orderBy("_range").collect()
        self.starts, self.row_count = [], 0      # (range, rows before it), at most MOST_RANGES
        for r in counts:
            self.starts.append((r["_range"], self.row_count))
            self.row_count += r["n"]

    @classmethod
    def build(cls, df: DataFrame, request: dict, path: str | None = None,
              rows_per_range: int = ROWS_PER_RANGE) -> PageIndex:
        """Deal the filtered rows into ranges of about ``rows_per_range`` (more, beyond ``MOST_RANGES`` ranges)."""
        spark = df.sparkSession
        path = path or scratch_path(spark, "page-index")
        filtered = apply_filters(df, request.get("filterModel"))
        n = min(max(1, -(-filtered.count() // rows_per_range)), MOST_RANGES)
        ranged = filtered.repartitionByRange(n, *sort_columns(filtered, request.get("sortModel")))
        ranged.withColumn("_range", F.spark_partition_id()).write.partitionBy("_range").parquet(path)
        return cls(spark, path, request, df.schema)

    def page(self, start: int = 0, end: int | None = None, position: str = "_position") -> DataFrame:
        """Rows ``start`` to ``end`` (to the last one: None) of the order, with their ``position`` from 0."""
        end = self.row_count if end is None else min(end, self.row_count)
        after = [b for _, b in self.starts[1:]] + [self.row_count]
        touched = [(r, b) for (r, b), a in zip(self.starts, after if self.starts else [], strict=True) if b < end and a > start]
        rows = self.table.filter(F.col("_range").isin([r for r, _ in touched])) if len(touched) <= 100 else (
            self.table.filter(F.col("_range").between(touched[0][0], touched[-1][0])))
        order = sort_columns(rows.drop("_range"), self.sort_model)
        before = self.table.sparkSession.createDataFrame(touched, "_range int, _before long")
        at = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
        return (rows.withColumn("_at", at).join(F.broadcast(before), "_range")   # at most MOST_RANGES rows
                .withColumn(position, (F.col("_before") + F.col("_at")).cast("long"))
                .filter((F.col(position) >= start) & (F.col(position) < end)).drop("_range", "_at", "_before"))


def grid_query(df: DataFrame, request: dict) -> GridResult:
    filtered = apply_filters(df, request.get("filterModel"))
    start = int(request.get("startRow") or 0)
    end = request.get("endRow")
    if (start > 0 and end is None) or (end is not None and int(end) > SHALLOW_ROWS):
        index = PageIndex.build(df, request)
        page = index.page(start, None if end is None else int(end))
        count = df.sparkSession.createDataFrame([(index.row_count,)], "rowCount long")
        return GridResult(page.orderBy("_position").drop("_position"), count)
    page = filtered.orderBy(*sort_columns(filtered, request.get("sortModel")))
    page = page.offset(start) if start else page
    if end is not None:
        page = page.limit(max(int(end) - start, 0))
    return GridResult(page, filtered.agg(F.count("*").alias("rowCount")))
