"""The registered queries: each takes a session and a folder of parquet tables and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark import fixed_values as fixed
from tallymark.functions.normalize import normalised
from tallymark.functions.rules import broken
from tallymark.functions.text import aliased, quoted
from tallymark.operators import loads
from tallymark.operators.bucketed import compare_bucketed, write_bucketed
from tallymark.operators.compare import Comparison, compare
from tallymark.operators.defects import Defect, inject_defects, inject_exactly, negative_count
from tallymark.operators.duplicates import duplicate_message
from tallymark.operators.foreign_keys import orphan_rows
from tallymark.operators.reload import ReloadBroken, journal, reload_all
from tallymark.plans import catalogue, checks, mapping, results
from tallymark.plans.checks import CheckContext, check_results
from tallymark.plans.failures import detail_records, failure_records
from tallymark.plans.suite import SuiteRun, run_suite
from tallymark.plans.tickets import FINDING_COLUMNS, findings, tickets
from tallymark.plans.verdicts import verdict
from tallymark.registry import derive
from tallymark.registry.derive import L1, L2, L3, ORDER_VALUES, given
from tallymark.session import shared_folder
from tallymark.sources.history import check_history, history, record_run
from tallymark.sources.literal import literal_rows
from tallymark.sources.metadata import column_profile
from tallymark.sources.snapshot import Link, RestoreRefused, restore_linked, restore_snapshot, write_snapshot
from tallymark.spec import ForeignKeySpec, LayerSpec, LookupSpec, RuleSpec, TableSpec

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
RESULT_FIELDS = ["layer", "table", "validation", "category", "status", "message"]


def query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# ---- sources -----------------------------------------------------------------------------------------------------


@query
def scan_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["o_orderkey", "o_custkey", "o_totalprice"]
    store = derive.store(spark, sf_dir)
    return store.read_table("source", "orders", columns, "o_orderstatus = 'F' and o_totalprice > 400000")


@query
def scan_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.store(spark, sf_dir).read_query(
        "source",
        "select o_orderstatus, count(*) as n_orders, max(o_totalprice) as max_price "
        "from {orders} join {customer} on o_custkey = c_custkey where c_acctbal > 0 group by o_orderstatus",
    )


@query
def filtered_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.store(spark, sf_dir).row_count("prestaging", "ps_orders", "o_custkey is null")


@query
def column_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_profile(derive.store(spark, sf_dir).table("prestaging", "ps_orders"))


@query
def snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two schemas with a table of the same name, and a third table: all come back."""
    root = shared_folder(spark, "snapshot")
    customer, orders = given(spark, sf_dir, "customer"), given(spark, sf_dir, "orders")
    columns = {
        "sales.customer": ["c_custkey as row_key", "c_acctbal as amount"],
        "sales.orders": ["o_orderkey as row_key", "o_totalprice as amount"],
        "old.orders": ["o_orderkey as row_key", "o_totalprice as amount"],
    }
    tables = {"sales.customer": customer, "sales.orders": orders, "old.orders": orders.where("o_orderstatus = 'F'")}
    write_snapshot(tables, f"{root}/golden")
    restored = restore_snapshot(spark, f"{root}/golden", list(tables), f"{root}/source")
    parts = [restored[name].selectExpr(f"'{name}' as table_name", *columns[name]) for name in tables]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def restore_linked_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four linked tables restored parents first, and the orphans for which a snapshot that lost customers is refused."""
    root = shared_folder(spark, "snapshot")
    tables = {name: given(spark, sf_dir, name) for name in ("lineitem", "orders", "supplier", "customer")}
    links = [
        Link("lineitem", "l_orderkey", "orders", "o_orderkey"),
        Link("lineitem", "l_suppkey", "supplier", "s_suppkey"),
        Link("orders", "o_custkey", "customer", "c_custkey"),
    ]
    write_snapshot(tables, f"{root}/good")
    write_snapshot({**tables, "customer": tables["customer"].where("c_custkey % 50 <> 0")}, f"{root}/bad")
    restored = restore_linked(spark, f"{root}/good", list(tables), f"{root}/source", links)
    shown = {
        "lineitem": ("l_orderkey", "l_extendedprice"),
        "orders": ("o_orderkey", "o_totalprice"),
        "supplier": ("s_suppkey", "s_acctbal"),
        "customer": ("c_custkey", "c_acctbal"),
    }
    parts = [
        df.selectExpr(f"'{name}' as table_name", f"cast({shown[name][0]} as bigint) as row_key", f"cast({shown[name][1]} as double) as amount")
        for name, df in restored.items()
    ]
    try:
        restore_linked(spark, f"{root}/bad", list(tables), f"{root}/source", links)
    except RestoreRefused as refused:
        orphans = refused.orphans.selectExpr(
            "concat('refused: ', child, '.', column) as table_name", "cast(key as bigint) as row_key", "cast(n_rows as double) as amount"
        )
        parts.append(orphans)
    return reduce(lambda a, b: a.unionByName(b), parts)


@query
def column_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = derive.store(spark, sf_dir).columns("prestaging", "ps_orders")
    return literal_rows(spark, {"name": "string", "ordinal": "int"}, [(c, i) for i, c in enumerate(found, start=1)])


# ---- comparison --------------------------------------------------------------------------------------------------


def orders_comparison(spark: SparkSession, sf_dir: str, case_insensitive: bool = False) -> Comparison:
    orders = given(spark, sf_dir, "orders")
    return compare(orders, derive.orders_target(orders), ["o_orderkey"], ORDER_VALUES, case_insensitive)


@query
def normalise_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive.store(spark, sf_dir).table("prestaging", "ps_orders")
    values = {c: normalised(quoted(c), rows.schema[c].dataType) for c in ORDER_VALUES}
    return rows.selectExpr("o_orderkey", *aliased(values))


@query
def compare_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_comparison(spark, sf_dir).keyed_states()


@query
def cell_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_comparison(spark, sf_dir).diffs()


@query
def bucketed_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of ``cell_diffs``, from two bucketed snapshots that meet without a shuffle."""
    orders = given(spark, sf_dir, "orders")
    root = shared_folder(spark, "bucketed")
    mark = root.rsplit("-", 1)[1]
    source, target = f"bucketed_source_{mark}", f"bucketed_target_{mark}"
    write_bucketed(orders, source, ["o_orderkey"], 16, f"{root}/source")
    write_bucketed(derive.orders_target(orders), target, ["o_orderkey"], 16, f"{root}/target")
    return compare_bucketed(spark, source, target, ["o_orderkey"], ORDER_VALUES).diffs()


@query
def case_folding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that differ in case only, in ways that lower-casing does not see, and names that differ in more."""
    customer = given(spark, sf_dir, "customer")
    texts = ["'stra\u00dfe '", "'\u03bf\u03b4\u03cc\u03c2 '", "'\ufb01ne '", "'Fine '", "'I\u0131 '", "'\u1e9e '"]
    others = ["'STRASSE '", "'\u039f\u0394\u038c\u03a3 '", "'FINE '", "'fyne '", "'II '", "'Ss '"]

    def named(some: list[str]) -> DataFrame:
        return customer.selectExpr("c_custkey", f"concat(element_at(array({', '.join(some)}), cast(c_custkey % 6 as int) + 1), c_name) as name")

    source, target = named(texts), named(others)
    plain = compare(source, target, ["c_custkey"], ["name"], case_insensitive=True)
    screened = compare(source, target, ["c_custkey"], ["name"], case_insensitive=True).screen()
    return plain.diffs().selectExpr("*", "'plain' as way").unionByName(screened.diffs().selectExpr("*", "'screened' as way"))


@query
def comparison_screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimals that differ in the last of 21 digits, compared exactly after screening by fingerprints."""
    big = "cast(1000000000000000000.01BD + o_orderkey as decimal(38,2))"
    orders = given(spark, sf_dir, "orders")
    source = orders.selectExpr("o_orderkey", f"{big} as amount")
    target = orders.selectExpr(
        "o_orderkey", f"cast({big} + if(o_orderkey % 5 = 0, 0.01BD, 0BD) as decimal(38,2)) as amount"
    )
    screened = compare(source, target, ["o_orderkey"], ["amount"], exact_decimals=True).screen()
    return screened.summary().select("diffs", "missing_in_target", "missing_in_source", "is_match")


@query
def diff_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = orders_comparison(spark, sf_dir, case_insensitive=True).diff_pairs()
    sides = [f"{side}_row.{c} as {side}_{c}" for side in ("source", "target") for c in derive.ORDER_COLUMNS]
    return pairs.selectExpr("concat_ws(',', diff_columns) as diff_columns", *sides)


@query
def missing_in_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_comparison(spark, sf_dir).missing_in_target()


@query
def missing_in_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_comparison(spark, sf_dir).missing_in_source()


@query
def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = given(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate")
    shipped = items.where("l_shipdate >= timestamp'1997-01-01'")
    return compare(items, shipped, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_quantity"]).duplicates()


@query
def comparison_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_comparison(spark, sf_dir).summary()


# ---- checks ------------------------------------------------------------------------------------------------------


def _context(spark: SparkSession, sf_dir: str, layer: str, table: str) -> CheckContext:
    return CheckContext.of(derive.store(spark, sf_dir), derive.pipeline(), layer, table)


def _lineitem_context(spark: SparkSession, sf_dir: str) -> CheckContext:
    """Lineitem has natural duplicates of (order, line)."""
    store = derive.store(spark, sf_dir)
    store.register("source", "lineitem", given(spark, sf_dir, "lineitem"))
    table = TableSpec("Lineitem", "lineitem", "lineitem", key=("l_orderkey", "l_linenumber"))
    return CheckContext(store, LayerSpec("Items", "source", "source", {"Lineitem": table}), table)


def _results(ctx: CheckContext, *names: str) -> DataFrame:
    return check_results(ctx, names).select(*RESULT_FIELDS)


@query
def count_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = _results(_context(spark, sf_dir, L2, "Orders"), checks.COUNT)
    return total.unionByName(_results(_context(spark, sf_dir, L3, "Customers"), checks.COUNT))


@query
def duplicate_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    natural = _results(_lineitem_context(spark, sf_dir), checks.DUPLICATE)
    return natural.unionByName(_results(_context(spark, sf_dir, L1, "Orders"), checks.DUPLICATE))


@query
def duplicate_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The duplicated keys of three tables in one line each; customers of the same segment and nation repeat a null key, too."""
    store = derive.store(spark, sf_dir)
    segments = given(spark, sf_dir, "customer").selectExpr("if(c_nationkey = 3, null, c_nationkey) as nation", "c_mktsegment as segment")
    tables = {
        "lineitem": (given(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]),
        "ps_orders": (store.table("prestaging", "ps_orders"), ["o_orderkey"]),
        "segments": (segments, ["nation", "segment"]),
        "customer": (given(spark, sf_dir, "customer"), ["c_custkey"]),
    }
    parts = [duplicate_message(rows, keys).selectExpr(f"'{name}' as table_name", "*") for name, (rows, keys) in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query
def null_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(_context(spark, sf_dir, L1, "Orders"), checks.NULL)


@query
def metadata_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column check of a target without one column, together with the row count that does not depend on it."""
    ctx = _context(spark, sf_dir, L1, "Orders")
    ctx.store.register("prestaging", "ps_orders", ctx.store.table("prestaging", "ps_orders").drop("o_orderpriority"))
    return _results(ctx, checks.METADATA, checks.COUNT)


@query
def constraint_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    natural = _results(_lineitem_context(spark, sf_dir), checks.CONSTRAINT)
    return natural.unionByName(_results(_context(spark, sf_dir, L3, "Customers"), checks.CONSTRAINT))


@query
def direct_move_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = _results(_context(spark, sf_dir, L1, "Orders"), checks.DIRECT_MOVE)
    return moved.unionByName(_results(_context(spark, sf_dir, L1, "Customers"), checks.DIRECT_MOVE))


@query
def integrity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = _results(_context(spark, sf_dir, L2, "Orders"), checks.INTEGRITY)
    return staged.unionByName(_results(_context(spark, sf_dir, L3, "Customers"), checks.INTEGRITY))


@query
def transformation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules on the unfiltered pre-staging rows, where they break, and on the accepted rows, where they hold."""
    store, staged = derive.store(spark, sf_dir), derive.pipeline().table(L2, "Orders")
    raw = TableSpec("Raw", "orders", "ps_orders", staged.key, transformations=staged.transformations)
    layer = LayerSpec(L1, "source", "prestaging", {"Raw": raw})
    broken_rules = _results(CheckContext(store, layer, raw), checks.TRANSFORMATION)
    return broken_rules.unionByName(_results(_context(spark, sf_dir, L2, "Orders"), checks.TRANSFORMATION))


def _customer_keys(spark: SparkSession, sf_dir: str, null_aware: bool) -> CheckContext:
    """Orders against customers of which every fiftieth is absent, or has a NULL key."""
    store = derive.store(spark, sf_dir)
    key = "if(c_custkey % 50 = 0, null, c_custkey) as c_custkey"
    known = given(spark, sf_dir, "customer").selectExpr(key)
    store.register("prestaging", "known_customer", known if null_aware else known.where("c_custkey is not null"))
    fk = ForeignKeySpec("o_custkey", "known_customer", "c_custkey", allow_null=null_aware, null_aware=null_aware)
    table = TableSpec("Orders", "orders", "ps_orders", ("o_orderkey",), foreign_keys=(fk,))
    return CheckContext(store, LayerSpec(L1, "source", "prestaging", {"Orders": table}), table)


@query
def fk_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(_customer_keys(spark, sf_dir, null_aware=False), checks.FOREIGN_KEY)


@query
def fk_check_null_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(_customer_keys(spark, sf_dir, null_aware=True), checks.FOREIGN_KEY)


@query
def fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _customer_keys(spark, sf_dir, null_aware=False).store
    known = store.table("prestaging", "known_customer")
    return orphan_rows(store.table("prestaging", "ps_orders"), "o_custkey", known, "c_custkey")


@query
def column_values_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(_context(spark, sf_dir, L3, "Orders"), checks.COLUMN_VALUES)


@query
def basic_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five basic checks of one table, fused."""
    return _results(_context(spark, sf_dir, L1, "Orders"), *catalogue.BASE_CHECKS)


# ---- rules -------------------------------------------------------------------------------------------------------


def _breaking_rows(rows: DataFrame, key: str, rule: RuleSpec) -> DataFrame:
    return rows.where(broken(rule, rows.schema)).select(key, rule.column)


def _order_rule(name: str, column: str, value=None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = derive.store(spark, sf_dir).table("prestaging", "ps_orders")
        return _breaking_rows(rows, "o_orderkey", RuleSpec(column, name, value))

    return run


_QUERIES["rule_not_null"] = _order_rule("not_null", "o_custkey")
_QUERIES["rule_no_whitespace"] = _order_rule("no_whitespace", "o_orderpriority")
_QUERIES["rule_length_equals"] = _order_rule("length_equals", "o_orderpriority", 5)
_QUERIES["rule_in_set"] = _order_rule("in_set", "o_orderstatus", ["F", "O", "P"])
_QUERIES["rule_regex"] = _order_rule("regex", "o_orderpriority", "[1-5]-")


@query
def rule_min_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _breaking_rows(given(spark, sf_dir, "customer"), "c_custkey", RuleSpec("c_acctbal", "min_value", 0))


def _double_rule(name: str, value) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = given(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_totalprice * 1000 as price")
        return _breaking_rows(rows, "o_orderkey", RuleSpec("price", name, value))

    return run


_QUERIES["rule_length_equals_double"] = _double_rule("length_equals", 10)
_QUERIES["rule_in_set_double"] = _double_rule("in_set", ["10000000.0", "20000000.0"])
_QUERIES["rule_regex_double"] = _double_rule("regex", "[12][0-9.]*$")


# ---- runs and summaries ------------------------------------------------------------------------------------------


def _suite(spark: SparkSession, sf_dir: str, **options) -> SuiteRun:
    return run_suite(derive.store(spark, sf_dir), derive.pipeline(), **options)


@query
def results_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.ordered_results(_suite(spark, sf_dir).results).select("seq", *RESULT_FIELDS)


_SHORT = ["seq", "layer", "table", "validation", "status"]


@query
def failed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.failures(_suite(spark, sf_dir).results).select(*_SHORT)


@query
def executed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.executed(_suite(spark, sf_dir, only=["count_check", "fact"]).results).select(*_SHORT)


@query
def skipped_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.skipped(_suite(spark, sf_dir, only=["count_check", "fact"]).results).select(*_SHORT)


@query
def run_with_broken_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule whose pattern is invalid and a table whose database is unknown cost their own checks only."""
    spec = derive.pipeline()
    orders = replace(spec.table(L1, "Orders"), transformations=(RuleSpec("o_orderstatus", "regex", "("),))
    absent = replace(orders, name="Absent", source_table="absent", transformations=())
    layer = replace(
        spec.layer(L1), tables={"Orders": orders, "Absent": absent}, valid_filter="true", source_db="source"
    )
    found = run_suite(derive.store(spark, sf_dir), replace(spec, layers={L1: layer}))
    return found.results.select("layer", "table", "validation", "status")


@query
def select_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _suite(spark, sf_dir, only=["count_check", "fact"])
    return results.ordered_results(run.results).select("seq", *RESULT_FIELDS)


@query
def gated_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prerequisite compares the row counts of the first layer; it fails, so nothing else runs."""

    def counts_agree() -> tuple[bool, str]:
        row = check_results(_context(spark, sf_dir, L1, "Orders"), [checks.COUNT]).first()
        return row["status"] == "PASS", row["message"]

    return _suite(spark, sf_dir, gate=counts_agree).results.select("seq", *RESULT_FIELDS)


@query
def summary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.summary_counts(_suite(spark, sf_dir).results)


@query
def summary_by_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.summary_by_layer(_suite(spark, sf_dir).results)


@query
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a timed run in which one target lost a column, so that some of its checks cannot run."""
    store = derive.store(spark, sf_dir)
    store.register("prestaging", "ps_customer", store.table("prestaging", "ps_customer").drop("c_name"))
    run = run_suite(store, derive.pipeline(), timed=True)
    return results.run_totals(run.results).drop("duration")


@query
def check_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that each check of a timed run has read."""
    return _suite(spark, sf_dir, timed=True).volumes(spark).select("layer", "table", "validation", "rows_read")


@query
def existence_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of every check of the run, each ended at the first problem."""
    store, spec = derive.store(spark, sf_dir), derive.pipeline()
    rows = [(c.layer, c.table, c.check, verdict(CheckContext.of(store, spec, c.layer, c.table), c.check)) for c in catalogue.cases(spec)]
    return literal_rows(spark, {"layer": "string", "table": "string", "validation": "string", "status": "string"}, rows)


@query
def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs, the second one after a target lost a column and recorded twice: the history of every check."""
    root, store = shared_folder(spark, "history"), derive.store(spark, sf_dir)
    first = run_suite(store, derive.pipeline()).results
    record_run({"results": first}, root, "2024-01", datetime(2024, 1, 1))
    store.register("prestaging", "ps_customer", store.table("prestaging", "ps_customer").drop("c_name"))
    second = run_suite(store, derive.pipeline()).results
    for _ in range(2):
        record_run({"results": second}, root, "2024-02", datetime(2024, 2, 1))
    found = check_history(history(spark, root, "results"))
    return found.select("run", "layer", "table", "validation", "status", "previous", "change")


# ---- failures and tickets ----------------------------------------------------------------------------------------


@query
def failure_records_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _suite(spark, sf_dir, only=["orders"], keep_issues=True)
    return failure_records(run, "Orders").withColumn("highlight", F.concat_ws(",", "highlight"))


_QUERIES["failure_records"] = _QUERIES.pop("failure_records_orders")


@query
def detail_records_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first forty failure records of each table of the run, and how many there are."""
    run = _suite(spark, sf_dir, keep_issues=True)
    return detail_records(run, 40).drop("row").withColumn("highlight", F.concat_ws(",", "highlight"))


@query
def findings_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(_suite(spark, sf_dir, keep_issues=True)).select(*FINDING_COLUMNS)


_QUERIES["findings"] = _QUERIES.pop("findings_orders")


@query
def tickets_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tickets(_suite(spark, sf_dir, keep_issues=True)).select(
        *[F.col(f"`{c}`").alias(c.lower().replace(" ", "_")) for c in fixed.TICKET_COLUMNS]
    )


_QUERIES["tickets"] = _QUERIES.pop("tickets_orders")


# ---- catalogue ---------------------------------------------------------------------------------------------------


@query
def mapping_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, spec = derive.store(spark, sf_dir), derive.pipeline()
    first, second, third = (mapping.mapping_document(store, spec, layer, observed=True) for layer in (L1, L2, L3))
    return first.unionByName(second).unionByName(third).drop("seq")


@query
def constraint_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared constraints of a table beside the NULLs its columns hold."""
    store, spec = derive.store(spark, sf_dir), derive.pipeline()
    labels = mapping.constraint_text(mapping.declared_labels(spark, spec, "ps_orders", spec.table(L1, "Orders")))
    profile = column_profile(store.table("prestaging", "ps_orders"))
    found = profile.join(labels, F.col("name") == F.col("label_column"), "left")
    return found.select("name", F.coalesce("constraints", F.lit("")).alias("constraints"), "null_count")


@query
def check_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documented cases with the outcome of the run."""
    cases = catalogue.check_catalogue(spark, derive.pipeline())
    outcome = _suite(spark, sf_dir).results.select("layer", "table", "validation", "status")
    at = (
        (cases["Layer"] == outcome["layer"])
        & (cases["Table"] == outcome["table"])
        & (cases["Suggested Validation"] == outcome["validation"])
    )
    return cases.join(outcome, at, "left").select(
        F.col("TestCaseID").alias("test_case_id"),
        cases["Layer"].alias("layer"),
        cases["Table"].alias("table_name"),
        F.col("`Column(s)`").alias("columns"),
        F.col("TestType").alias("test_type"),
        F.col("Priority").alias("priority"),
        F.concat_ws(",", "tags").alias("tags"),
        F.col("Description").alias("description"),
        F.col("Precondition").alias("precondition"),
        F.col("`Test Steps`").alias("steps"),
        F.col("`Expected Result`").alias("expected"),
        "status",
    )


# ---- loads and test data -----------------------------------------------------------------------------------------


@query
def reload_all_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the tables that a full reload leaves, reduced to one layout: surrogate or natural keys, an amount and a text."""
    store = reload_all(
        spark, derive.reload_pipeline(), derive.reload_sources(spark, sf_dir), shared_folder(spark, "reload"), "first", datetime(2024, 1, 1)
    )
    rejected = "concat_ws('|', cast(IsValid as string), RejectionReason)"
    columns = {
        ("prestaging", "ps_supplier"): ["s_suppkey", "s_nationkey", "null", "null", "s_acctbal", "s_name"],
        ("prestaging", "ps_lineitem"): ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", "null"],
        ("staging", "stg_orders"): ["o_orderkey", "o_custkey", "null", "null", "o_totalprice", rejected],
        ("staging", "stg_customer"): ["c_custkey", "c_nationkey", "null", "null", "c_acctbal", rejected],
        ("staging", "stg_lineitem"): ["l_orderkey", "l_linenumber", "l_suppkey", "null", "l_extendedprice", rejected],
        ("dwh", "dim_customer"): ["CustomerSK", "c_custkey", "c_nationkey", "IsCurrent", "c_acctbal", "concat(c_name, '|', c_mktsegment)"],
        ("dwh", "dim_supplier"): ["SupplierSK", "s_suppkey", "s_nationkey", "null", "s_acctbal", "s_name"],
        ("dwh", "dim_orders"): ["OrderSK", "o_orderkey", "o_custkey", "null", "o_totalprice", "concat(o_orderstatus, '|', o_orderpriority)"],
        ("dwh", "fact_lineitem"): ["OrderSK", "SupplierSK", "CustomerSK", "l_linenumber", "l_extendedprice", "null"],
    }
    parts = [
        store.table(*at).selectExpr(
            f"'{at[1]}' as table_name",
            *[f"cast({value} as bigint) as k{i}" for i, value in enumerate(shown[:4], start=1)],
            f"cast({shown[4]} as double) as amount",
            f"cast({shown[5]} as string) as note",
        )
        for at, shown in columns.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query
def reload_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reload that breaks in its third level for want of a column, and its resumption: the journal has each stage once."""
    root, good = shared_folder(spark, "reload"), derive.reload_sources(spark, sf_dir)
    spec = derive.reload_pipeline()
    broken = spec.table(L3, "Orders")
    worse = replace(spec.layer(L3), tables={**spec.layer(L3).tables, "Orders": replace(broken, source_table="absent")})
    try:
        reload_all(spark, replace(spec, layers={**spec.layers, L3: worse}), good, root, "first", datetime(2024, 1, 1))
    except (ReloadBroken, ValueError):
        pass
    reload_all(spark, spec, good, root, "first", datetime(2024, 1, 1))
    return journal(spark, root, "first").select("level", "database", "table", "row_count")


@query
def load_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loads.load_direct(given(spark, sf_dir, "orders"))


@query
def load_cleanse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive.store(spark, sf_dir).table("prestaging", "ps_orders")
    return loads.cleanse(rows, lower_case_columns=["o_orderstatus"])


@query
def load_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = derive.store(spark, sf_dir)
    return loads.load_staging(store.table("prestaging", "ps_orders"), derive.pipeline().table(L2, "Orders"))


@query
def load_scd1(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = given(spark, sf_dir, "customer")
    current = loads.load_scd1(None, customer, ["c_custkey"], "CustomerSK")
    return loads.load_scd1(current, derive.customer_versions(customer), ["c_custkey"], "CustomerSK")


@query
def load_scd2(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = given(spark, sf_dir, "customer")
    first, second = datetime(2024, 1, 1), datetime(2024, 2, 1)
    current = loads.load_scd2(None, customer, ["c_custkey"], "CustomerSK", first)
    return loads.load_scd2(current, derive.customer_versions(customer), ["c_custkey"], "CustomerSK", second)


@query
def load_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items: supplier and part keys become surrogate keys, the customer comes through the order."""
    orders = given(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey", "o_orderkey + 1000 as OrderSK")
    supplier = given(spark, sf_dir, "supplier").where("s_suppkey % 10 <> 3").selectExpr("s_suppkey", "s_suppkey + 5 as SupplierSK")
    dimensions = {
        "orders": orders,
        "customer": derive.customer_dimension(given(spark, sf_dir, "customer")).where("IsCurrent = 1"),
        "supplier": supplier,
    }
    lookups = [
        LookupSpec("l_orderkey", "orders", "o_orderkey", "OrderSK", carry=("o_custkey",)),
        LookupSpec("l_suppkey", "supplier", "s_suppkey", "SupplierSK"),
        LookupSpec("o_custkey", "customer", "c_custkey", "CustomerSK"),
    ]
    items = given(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice"
    )
    return loads.load_fact(items, lookups, dimensions)


@query
def inject_defects_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inject_defects(
        given(spark, sf_dir, "customer"),
        [
            Defect("c_custkey % 20 = 1", "c_name", "concat('  ', c_name, '  ')", "name has spaces"),
            Defect("c_custkey % 20 = 2", "c_mktsegment", "'X'", "segment is unknown"),
            Defect("c_custkey % 30 = 3", "c_acctbal", "-abs(c_acctbal)", "balance is negative"),
            Defect("c_custkey % 25 = 2", "c_name", "lower(c_name)", "lower-case name", negative=False),
        ],
    )


@query
def inject_exact_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six kinds of defects in 25 rows, of which 8 are negative, at every scale."""
    rows = given(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "c_name", "concat('c', c_custkey, '@example.com') as email", "lpad(c_nationkey, 3, '0') as code", "c_acctbal", "c_mktsegment"
    )
    counts = [
        (Defect("", "c_name", "concat('  ', c_name, '  ')", "name has spaces"), 2),
        (Defect("", "email", "'not-an-address'", "address is not valid"), 1),
        (Defect("", "c_mktsegment", "'X'", "segment is unknown"), 1),
        (Defect("", "c_acctbal", "-abs(c_acctbal) - 1", "balance is negative"), 2),
        (Defect("", "code", "substring(code, 1, 2)", "code has not three digits"), 2),
        (Defect("", "c_mktsegment", "lower(c_mktsegment)", "lower-case segment", negative=False), 17),
    ]
    return inject_exactly(rows, ["c_custkey"], counts, seed=7)


@query
def negative_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negative_count(inject_defects_customer(spark, sf_dir)).selectExpr("negative as negative_rows")


_QUERIES["inject_defects"] = _QUERIES.pop("inject_defects_customer")
