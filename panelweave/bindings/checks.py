"""Cleaning, validation and audit queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit, cleaning, manifest, rules
from ..sources import files
from .panel_tables import PANEL_SQL, panel
from .registry import query, r, rounded, table


_LABELLED = "docs as (select documents.*, quality, toxic from documents left join labels on documents.doc_id = labels.doc_id)"


def _with_holes(spark, sf):
    known = F.col("l_linenumber") != 7
    return table(spark, sf, "lineitem").select(
        F.when(known, F.col("l_orderkey")).alias("order_key"), F.when(known, F.col("l_linenumber")).alias("line_no")
    )


_HOLES = "h as (select case when l_linenumber <> 7 then l_orderkey end order_key, case when l_linenumber <> 7 then l_linenumber end line_no from lineitem)"


@query("clean_dedup", f"with {_HOLES} select distinct order_key, line_no from h where order_key is not null or line_no is not null")
def clean_dedup(spark, sf):
    return cleaning.clean_data(_with_holes(spark, sf))


@query(
    "clean_counts",
    f"""with {_HOLES}, k as (select * from h where order_key is not null or line_no is not null)
select (select count(*) from h) n_input, (select count(*) from h) - (select count(*) from k) n_empty,
       (select count(*) from k) - (select count(*) from (select distinct * from k)) n_duplicates,
       (select count(*) from (select distinct * from k)) n_kept""",
)
def clean_counts(spark, sf):
    return cleaning.cleaning_counts(_with_holes(spark, sf))


def _typed(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey",
        F.col("c_custkey").cast("string").alias("code"),
        F.col("c_name").alias("label"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"),
        F.col("c_nationkey").cast("string").alias("nation"),
    )


_TYPES = {"code": "int64", "label": "float64", "balance": "int64", "nation": "float64", "absent": "int64"}


@query(
    "convert_types",
    "select c_custkey, c_custkey code, c_name as label, case when c_acctbal >= 0 then c_acctbal end balance, cast(c_nationkey as double) nation from customer",
)
def convert_types(spark, sf):
    return cleaning.convert_types(_typed(spark, sf), _TYPES)


@query(
    "conversion_report",
    """select 'code' column_name, 'bigint' target_type, cast(0 as bigint) n_blocking, true converted
union all select 'label', 'double', count(*) filter (where try_cast(c_name as double) is null), false from customer
union all select 'balance', 'bigint', count(*) filter (where c_acctbal < 0), count(*) filter (where c_acctbal < 0) = 0 from customer
union all select 'nation', 'double', 0, true""",
)
def conversion_report(spark, sf):
    return cleaning.conversion_report(_typed(spark, sf), _TYPES)


@query(
    "clean_numeric",
    """select event_id, case when event_type = 'error' then 0.0 when user_id % 5 = 0 then 0.0 else value end as value from events""",
)
def clean_numeric(spark, sf):
    broken = table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_type") == "error", F.lit(float("inf")))
        .when(F.col("user_id") % 5 == 0, F.lit(float("nan")))
        .otherwise(F.col("value"))
        .alias("value"),
    )
    return cleaning.clean_numeric(broken, ["value"], fill_value=0.0)


@query("rename_columns", "select c_custkey id, c_acctbal outcome, c_mktsegment from customer")
def rename_columns(spark, sf):
    renamed = cleaning.rename_columns(table(spark, sf, "customer"), {"c_custkey": "id", "c_acctbal": "outcome", "none": "x"})
    return renamed.select("id", "outcome", "c_mktsegment")


@query("complete_cases", "select documents.doc_id, quality, toxic from documents left join labels on documents.doc_id = labels.doc_id where quality is not null and toxic is not null")
def complete_cases(spark, sf):
    return cleaning.complete_cases(_docs(spark, sf), ["quality", "toxic"]).select("doc_id", "quality", "toxic")


@query(
    "recode_sentinels",
    "select c_custkey, case when c_nationkey <> 7 then c_nationkey end code, case when c_mktsegment <> 'MACHINERY' then c_mktsegment end segment from customer",
)
def recode_sentinels(spark, sf):
    coded = table(spark, sf, "customer").select(
        "c_custkey",
        F.when(F.col("c_nationkey") == 7, -999).otherwise(F.col("c_nationkey")).alias("code"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "").otherwise(F.col("c_mktsegment")).alias("segment"),
    )
    return cleaning.recode_sentinels(coded, ["code", "segment"])


@query(
    "derive_columns",
    f"""select o_orderkey, greatest(o_totalprice, 1000) price, {r('ln(greatest(o_totalprice, 1000))', 'log_price')},
      cast(year(o_orderdate) as int) as year, cast(date_trunc('month', o_orderdate) as date) month_period from orders""",
)
def derive_columns(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_orderdate").cast("date").alias("d"))
    clipped = cleaning.derive_columns(orders, clips={"price": (1000.0, None)})
    wide = cleaning.derive_columns(clipped, logs=["price"], date="d")
    return rounded(wide.select("o_orderkey", "price", "log_price", "year", "month_period"), keep=["price"])


@query(
    "column_coverage",
    f"""with {_LABELLED} select 'doc_id,quality' present, 'author,year' missing, cast(0.5 as double) coverage_rate, count(*) n_rows, count(quality) n_complete from docs""",
)
def column_coverage(spark, sf):
    row = cleaning.column_coverage(_docs(spark, sf), ["doc_id", "quality", "author", "year"])
    return row.withColumns({c: F.array_join(c, ",") for c in ("present", "missing")})


@query(
    "union_sources",
    """select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, cast(null as bigint) s_suppkey, cast(null as varchar) s_name, cast(null as int) s_nationkey, cast(null as double) s_acctbal, 'customer' source_name from customer
union all select null, null, null, null, null, s_suppkey, s_name, s_nationkey, s_acctbal, 'supplier' from supplier""",
)
def union_sources(spark, sf):
    paths = files.find_input_files(spark, sf, ["customer.parquet", "supplier.parquet"])
    stacked, _ = files.load_all_sources(spark, paths, source_column="source_name")
    return stacked


@query(
    "source_row_counts",
    " union all ".join(
        f"select '{n}' source_name, count(*) n_rows from {n}"
        for n in ("customer", "documents", "events", "lineitem", "orders", "part", "supplier")
    ),
)
def source_row_counts(spark, sf):
    """Counts that read no column; one branch per source."""
    names = ("customer", "documents", "events", "lineitem", "orders", "part", "supplier")
    counts = [
        files.load_data(spark, f"{sf}/{n}.parquet").agg(F.lit(n).alias("source_name"), F.count(F.lit(1)).alias("n_rows"))
        for n in names
    ]
    return reduce(DataFrame.unionByName, counts)


_VERDICT = ["rule_name", "passed", "severity", "n_violations"]


def _rule_sql(source: str, entries: list[tuple[str, str, str]]) -> str:
    return " union all ".join(
        f"select '{name}' rule_name, v = 0 passed, '{severity}' severity, cast(v as bigint) n_violations from (select {violations} v from {source})"
        for name, severity, violations in entries
    )


@query(
    "validate_rules",
    _rule_sql(
        "orders",
        [
            ("row_count", "error", "case when count(*) < 1 then 1 else 0 end"),
            ("no_missing_values", "error", "count(*) filter (where o_orderkey is null) + count(*) filter (where o_custkey is null)"),
            ("unique_values:o_orderkey", "error", "count(*) - count(distinct o_orderkey)"),
            ("unique_values:o_custkey", "error", "count(*) - count(distinct o_custkey)"),
            ("value_range:o_totalprice", "warning", "count(*) filter (where o_totalprice < 1000) + count(*) filter (where o_totalprice > 400000)"),
            ("categorical_values:o_orderstatus", "error", "count(*) filter (where o_orderstatus not in ('F', 'O'))"),
            ("date_range:o_orderdate", "warning", "count(*) filter (where o_orderdate < timestamp '1995-06-01') + count(*) filter (where o_orderdate > timestamp '1998-01-01')"),
            ("no_duplicate_rows", "error", "count(*) - count(distinct (o_custkey, o_orderstatus, o_orderpriority))"),
            ("value_pattern:o_orderpriority", "error", "count(*) filter (where not regexp_matches(o_orderpriority, '^[1-5]-'))"),
            ("no_future_dates:o_orderdate", "warning", "count(*) filter (where o_orderdate > now()::timestamp)"),
        ],
    ),
)
def validate_rules(spark, sf):
    """Ten rules over orders, keys included, in one aggregate."""
    validator = rules.DataValidator().add_rules(
        [
            rules.row_count(min_rows=1),
            rules.no_missing_values(["o_orderkey", "o_custkey", "o_absent"]),
            rules.unique_values("o_orderkey"),
            rules.unique_values("o_custkey"),
            rules.value_range("o_totalprice", 1000, 400000),
            rules.categorical_values("o_orderstatus", ["F", "O"]),
            rules.date_range("o_orderdate", "1995-06-01", "1998-01-01"),
            rules.no_duplicate_rows(["o_custkey", "o_orderstatus", "o_orderpriority"]),
            rules.value_pattern("o_orderpriority", "[1-5]-"),
            rules.no_future_dates("o_orderdate"),
        ]
    )
    return validator.results(table(spark, sf, "orders")).select(*_VERDICT)


@query(
    "validate_customer",
    _rule_sql(
        "customer",
        [
            ("value_range:c_acctbal", "warning", "count(*) filter (where c_acctbal < 0)"),
            ("value_range:c_custkey", "error", "count(*) filter (where c_custkey < 0)"),
            ("strictly_positive:c_custkey", "error", "count(*) filter (where c_custkey <= 0)"),
            ("string_length:c_name", "warning", "count(*) filter (where length(c_name) < 5 or length(c_name) > 17)"),
            ("value_range:missing_column", "warning", "any_value(1)"),
            ("row_count", "error", "case when count(*) < 100000000 then 1 else 0 end"),
        ],
    ),
)
def validate_customer(spark, sf):
    validator = rules.DataValidator().add_rules(
        [
            rules.positive_values("c_acctbal"),
            rules.non_negative("c_custkey"),
            rules.strictly_positive("c_custkey"),
            rules.string_length("c_name", 5, 17),
            rules.value_range("missing_column", 0, 1),
            rules.row_count(min_rows=100000000),
        ]
    )
    return validator.results(table(spark, sf, "customer")).select(*_VERDICT)


@query("string_length", _rule_sql("supplier", [("string_length:s_name", "error", "count(*) filter (where length(s_name) < 18 or length(s_name) > 18)")]))
def string_length(spark, sf):
    rule = rules.string_length("s_name", 18, 18, severity="error")
    return rules.DataValidator().add_rule(rule).results(table(spark, sf, "supplier")).select(*_VERDICT)


@query("value_pattern", _rule_sql("part", [("value_pattern:p_brand", "error", "count(*) filter (where not regexp_matches(p_brand, '^Brand#1[0-9]?$'))")]))
def value_pattern(spark, sf):
    rule = rules.value_pattern("p_brand", "Brand#1[0-9]?$")
    return rules.DataValidator().add_rule(rule).results(table(spark, sf, "part")).select(*_VERDICT)


@query(
    "validate_lineitem",
    _rule_sql(
        "lineitem",
        [
            ("no_duplicate_rows", "error", "count(*) - count(distinct (l_orderkey, l_linenumber))"),
            ("value_range:l_discount", "warning", "count(*) filter (where l_discount < 0) + count(*) filter (where l_discount > 0.05)"),
            ("categorical_values:l_returnflag", "error", "count(*) filter (where l_returnflag not in ('A', 'N', 'R'))"),
            ("no_missing_values", "warning", "count(*) filter (where l_shipdate is null)"),
        ],
    ),
)
def validate_lineitem(spark, sf):
    validator = rules.DataValidator().add_rules(
        [
            rules.no_duplicate_rows(["l_orderkey", "l_linenumber"]),
            rules.value_range("l_discount", 0, 0.05),
            rules.categorical_values("l_returnflag", ["A", "N", "R"]),
            rules.no_missing_values(["l_shipdate"], severity="warning"),
        ]
    )
    return validator.results(table(spark, sf, "lineitem")).select(*_VERDICT)


@query(
    "invalid_values",
    "select p_type, count(*) as count from part where p_type not in (select p_type from part group by 1 having count(*) > (select count(*) / 5.0 from part)) group by 1",
)
def invalid_values(spark, sf):
    """Values outside a set that is itself a table."""
    part = table(spark, sf, "part")
    counted = part.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))
    total = part.agg((F.count(F.lit(1)) / 5.0).alias("t"))
    usual = counted.join(F.broadcast(total)).filter("n > t").select("p_type")
    return rules.invalid_values(part, "p_type", usual)


@query(
    "valid_coordinates",
    "select 'valid_coordinates' rule_name, v = 0 passed, 'error' severity, v n_violations from (select count(*) filter (where not (c_acctbal / 100 between -90 and 90)) v from customer)",
)
def valid_coordinates(spark, sf):
    points = table(spark, sf, "customer").select(
        (F.col("c_acctbal") / 100).alias("latitude"), (F.col("c_nationkey") * 7.0).alias("longitude")
    )
    return rules.DataValidator().add_rule(rules.valid_coordinates()).results(points).select(*_VERDICT)


@query(
    "validate_panel",
    f"with {PANEL_SQL}, " + "q as (" + _rule_sql(
        "panel",
        [
            ("no_missing_values", "error", "count(*) filter (where id is null) + count(*) filter (where period is null)"),
            ("no_duplicate_rows", "error", "count(*) - count(distinct (id, period))"),
            ("row_count", "error", "case when count(*) < 10 then 1 else 0 end"),
        ],
    ) + ") select * from q",
)
def validate_panel(spark, sf):
    return rules.panel_rules().results(panel(spark, sf)).select(*_VERDICT)


@query(
    "validate_input",
    _rule_sql(
        "documents",
        [
            ("row_count", "error", "case when count(*) < 1 then 1 else 0 end"),
            ("no_missing_values", "error", "count(*) filter (where doc_id is null)"),
            ("column_exists:author", "error", "any_value(1)"),
        ],
    ),
)
def validate_input(spark, sf):
    docs = table(spark, sf, "documents")
    return rules.input_rules(docs, ["doc_id", "author"]).results(docs).select(*_VERDICT)


@query(
    "report_summary",
    """with q as (select count(*) filter (where c_acctbal < 0) > 0 a, count(*) - count(distinct c_custkey) > 0 b, count(*) - count(distinct c_nationkey) > 0 c from customer)
select cast(3 as bigint) total, not (a or b or c) passed, b or c has_errors, a has_warnings, cast(b as bigint) + cast(c as bigint) error_count, cast(a as bigint) warning_count from q""",
)
def report_summary(spark, sf):
    validator = rules.DataValidator().add_rules(
        [rules.positive_values("c_acctbal"), rules.unique_values("c_custkey"), rules.unique_values("c_nationkey")]
    )
    return rules.report_summary(validator.results(table(spark, sf, "customer")))


_SCHEMA = {
    "doc_id": "int",
    "text": {"dtype": "str", "required": True},
    "n_chars": "float",
    "lang": {"dtype": "str", "values": ["en", "fr"]},
    "author": {"dtype": "str", "required": False},
    "year": "int",
}


@query(
    "schema_check",
    """select * from (values ('column:doc_id', true, 'info'), ('column:text', true, 'info'), ('column_type:n_chars', false, 'warning'),
('column:lang', true, 'info'), ('column_exists:author', true, 'info'), ('column_exists:year', false, 'error')) t(rule_name, passed, severity)
union all select 'categorical_values:lang', count(*) = 0, 'error' from documents where lang not in ('en', 'fr')""",
)
def schema_check(spark, sf):
    docs = table(spark, sf, "documents")
    schema = rules.schema_results(docs, _SCHEMA).select("rule_name", "passed", "severity")
    limits = rules.DataValidator().add_rules(rules.schema_rules(docs, _SCHEMA)).results(docs)
    return schema.unionByName(limits.select("rule_name", "passed", "severity"))


def _docs(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")


def _stages(spark, sf):
    docs, linked = table(spark, sf, "documents"), _docs(spark, sf)
    good = linked.filter(F.col("quality") == 1)
    stages = [("raw", docs), ("linked", linked), ("labelled", linked.filter("quality IS NOT NULL")), ("good", good)]
    rows = [audit.audit_frame(df, i, name) for i, (name, df) in enumerate(stages)]
    return reduce(DataFrame.unionByName, rows)


_DOCS_SQL = _LABELLED
_STAGE_SQL = f"""{_DOCS_SQL},
st as (select 0 stage_no, 'raw' stage_name, count(*) row_count, 5 column_count from documents
       union all select 1, 'linked', count(*), 7 from docs
       union all select 2, 'labelled', count(quality), 7 from docs
       union all select 3, 'good', count(*) filter (where quality = 1), 7 from docs)"""


@query("stage_audit", f"with {_STAGE_SQL} select stage_no, stage_name, true as exists, row_count, column_count from st")
def stage_audit(spark, sf):
    return _stages(spark, sf).select("stage_no", "stage_name", "exists", "row_count", "column_count")


@query(
    "stage_missing",
    f"with {_DOCS_SQL} " + " union all ".join(
        f"select 'linked' stage_name, '{c}' column_name, count(*) - count({c}) n_missing, {r(f'(count(*) - count({c})) * 100.0 / count(*)', 'percent_missing')} from docs"
        for c in ("quality", "toxic")
    ),
)
def stage_missing(spark, sf):
    return rounded(audit.stage_missing(_stages(spark, sf)))


@query(
    "stage_attrition",
    f"""with {_STAGE_SQL}, l as (select lag(stage_name) over (order by stage_no) from_stage, stage_name to_stage, lag(row_count) over (order by stage_no) from_rows, row_count to_rows from st where row_count > 0)
select *, to_rows - from_rows difference, {r('(to_rows - from_rows) * 100.0 / from_rows', 'percent_change')} from l where from_stage is not null""",
)
def stage_attrition(spark, sf):
    return rounded(audit.attrition(_stages(spark, sf)))


@query(
    "stage_compare",
    f"""with {_DOCS_SQL} select 'raw' stage1, 'good' stage2, (select count(*) from documents) row_count_1, count(*) row_count_2,
    count(*) - (select count(*) from documents) row_diff, 'quality,toxic' columns_added, 'source' columns_removed, 'doc_id,lang,n_chars,text' columns_common from docs where quality = 1""",
)
def stage_compare(spark, sf):
    good = _docs(spark, sf).filter(F.col("quality") == 1).drop("source")
    row = manifest.compare_columns(table(spark, sf, "documents"), good, "raw", "good")
    names = ("columns_added", "columns_removed", "columns_common")
    return row.withColumns({c: F.array_join(c, ",") for c in names})


@query(
    "missing_counts",
    f"with {_DOCS_SQL} " + " union all ".join(
        f"select '{c}' column_name, count(*) - count({c}) n_missing, {r(f'(count(*) - count({c})) * 100.0 / count(*)', 'percent_missing')} from docs"
        for c in ("quality", "toxic")
    ),
)
def missing_counts(spark, sf):
    return rounded(audit.missing_counts(_docs(spark, sf)))
