"""Tables derived from the given ones: a second version with known defects for each kind of check.

The given tables have no NULLs, orphans or padded text, so targets are derived by fixed formulas (FIXTURES.md). The
oracle SQL spells the same formulas out independently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.operators.loads import load_direct, load_staging
from tallymark.operators.lookup import lookup
from tallymark.session import materialised
from tallymark.sources.tables import TableStore
from tallymark.spec import (
    ConstraintSpec,
    ForeignKeySpec,
    LayerSpec,
    LookupSpec,
    PipelineSpec,
    RuleSpec,
    TableSpec,
)

ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
ORDER_VALUES = tuple(ORDER_COLUMNS[1:])
CUSTOMER_VALUES = ("c_name", "c_nationkey", "c_acctbal", "c_mktsegment")

L1, L2, L3 = "SourceToPreStaging", "PreStagingToStaging", "StagingToDWH"


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def orders_target(orders: DataFrame) -> DataFrame:
    """Orders with moved keys, lost and changed values, padding, dropped rows and repeated keys."""
    copies = F.expr("explode(sequence(1, if(ok % 101 = 0, 2, 1)))")
    return (
        orders.where("o_orderkey % 97 <> 0")
        .selectExpr(
            "if(o_orderkey % 103 = 0, o_orderkey + 100000000, o_orderkey) as o_orderkey",
            "if(o_orderkey % 73 = 0, null, o_custkey) as o_custkey",
            "if(o_orderkey % 79 = 0, lower(o_orderstatus), o_orderstatus) as o_orderstatus",
            "case when o_orderkey % 89 = 0 then o_totalprice + 1.0D "
            "when o_orderkey % 71 = 0 then o_totalprice + 1e-10D else o_totalprice end as o_totalprice",
            "o_orderdate",
            "case when o_orderkey % 83 = 0 then concat('  ', o_orderpriority, ' ') "
            "when o_orderkey % 67 = 0 then '' else o_orderpriority end as o_orderpriority",
            "o_orderkey as ok",
        )
        .select("*", copies.alias("copy"))
        .select(*ORDER_COLUMNS)
    )


def customer_versions(customer: DataFrame) -> DataFrame:
    """A later version of the customers: changed segments, changed balances, and additional customers."""
    changed = customer.selectExpr(
        "c_custkey",
        "c_name",
        "c_nationkey",
        "if(c_custkey % 7 = 0, c_acctbal + 10.0D, c_acctbal) as c_acctbal",
        "if(c_custkey % 5 = 0, concat('NEW ', c_mktsegment), c_mktsegment) as c_mktsegment",
    )
    added = customer.where("c_custkey % 4 = 0").selectExpr(
        "c_custkey + 10000000 as c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"
    )
    return changed.where("c_custkey % 9 <> 0").unionByName(added)


def customer_dimension(customer: DataFrame) -> DataFrame:
    """Type-2 dimension of the customers: some are absent, some have an expired version."""
    versions = customer.where("c_custkey % 50 <> 0").select(
        "*", F.expr("explode(if(c_custkey % 10 = 0, array(0, 1), array(1)))").alias("IsCurrent")
    )
    return versions.selectExpr(
        "c_custkey * 10 + IsCurrent as CustomerSK",
        "c_custkey",
        "upper(c_name) as c_name",
        "c_nationkey",
        "if(c_custkey % 11 = 0 or IsCurrent = 0, c_acctbal - 1.0D, c_acctbal) as c_acctbal",
        "c_mktsegment",
        "IsCurrent",
    )


ORDER_RULES = (
    RuleSpec("o_orderstatus", "in_set", ["F", "O", "P"], "Status must be a known upper-case value"),
    RuleSpec("o_orderpriority", "no_whitespace", None, "Priority must be trimmed"),
    RuleSpec("o_orderpriority", "regex", "[1-5]-", "Priority must start with its number"),
    RuleSpec("o_totalprice", "min_value", 2000, "Price must be at least 2000"),
)


def pipeline() -> PipelineSpec:
    """Three layers over the given tables, with the filters and check kinds of the bank's layers."""
    orders = dict(key=("o_orderkey",), compare_columns=ORDER_VALUES, not_null_columns=("o_orderkey", "o_custkey"))
    customers = dict(key=("c_custkey",), compare_columns=CUSTOMER_VALUES, not_null_columns=("c_custkey", "c_name"))
    layers = [
        LayerSpec(
            L1,
            "source",
            "prestaging",
            {
                "Customers": TableSpec("Customers", "customer", "ps_customer", **customers),
                "Orders": TableSpec("Orders", "orders", "ps_orders", **orders),
            },
            direct_move=True,
        ),
        LayerSpec(
            L2,
            "prestaging",
            "staging",
            {"Orders": TableSpec("Orders", "ps_orders", "stg_orders", transformations=ORDER_RULES, **orders)},
            valid_filter="IsValid = 1",
            tolerate_missing_in_target=True,
        ),
        LayerSpec(
            L3,
            "staging",
            "dwh",
            {
                "Customers": TableSpec(
                    "Customers",
                    "stg_customer",
                    "dim_customer",
                    target_filter="IsCurrent = 1",
                    dim_type="Type2",
                    **customers,
                ),
                "Orders": TableSpec(
                    "Orders",
                    "stg_orders",
                    "fact_orders",
                    key=("o_orderkey",),
                    compare_columns=("o_orderstatus", "o_totalprice", "o_orderdate"),
                    not_null_columns=("o_orderkey",),
                    dim_type="Fact",
                    foreign_keys=(ForeignKeySpec("CustomerSK", "dim_customer", "CustomerSK"),),
                    value_columns=("o_orderstatus", "o_totalprice", "o_orderpriority"),
                ),
            },
            source_valid_filter="IsValid = 1",
        ),
    ]
    return PipelineSpec(
        layers={layer.name: layer for layer in layers},
        databases={"source": "Sales_Source", "prestaging": "Sales_PreStaging", "staging": "Sales_Staging", "dwh": "Sales_DWH"},
        constraints=(
            ConstraintSpec("orders", "o_orderkey", "PRIMARY KEY"),
            ConstraintSpec("orders", "o_custkey", "FOREIGN KEY", "customer"),
            ConstraintSpec("ps_orders", "o_custkey", "FOREIGN KEY", "ps_customer"),
            ConstraintSpec("dim_customer", "CustomerSK", "PRIMARY KEY"),
            ConstraintSpec("dim_customer", "c_custkey", "UNIQUE"),
        ),
    )


ITEM_VALUES = ("l_quantity", "l_extendedprice")


def reload_pipeline() -> PipelineSpec:
    """Four tables through three layers, for a full reload: copies, accepted and rejected rows, two kinds of dimensions and a fact."""
    orders = dict(key=("o_orderkey",), compare_columns=ORDER_VALUES, not_null_columns=("o_orderkey", "o_custkey"))
    customers = dict(key=("c_custkey",), compare_columns=CUSTOMER_VALUES, not_null_columns=("c_custkey", "c_name"))
    suppliers = dict(key=("s_suppkey",), compare_columns=("s_name", "s_nationkey", "s_acctbal"))
    items = dict(key=("l_orderkey", "l_linenumber"), compare_columns=ITEM_VALUES)
    few = RuleSpec("l_quantity", "min_value", 5, "Quantity must be at least 5")
    debt = RuleSpec("c_acctbal", "min_value", 0, "Balance must not be negative")
    lookups = (
        LookupSpec("l_orderkey", "dim_orders", "o_orderkey", "OrderSK", carry=("o_custkey",)),
        LookupSpec("l_suppkey", "dim_supplier", "s_suppkey", "SupplierSK"),
        LookupSpec("o_custkey", "dim_customer", "c_custkey", "CustomerSK"),
    )
    first = {
        "Items": TableSpec("Items", "lineitem", "ps_lineitem", **items),
        "Customers": TableSpec("Customers", "customer", "ps_customer", **customers),
        "Suppliers": TableSpec("Suppliers", "supplier", "ps_supplier", **suppliers),
        "Orders": TableSpec("Orders", "orders", "ps_orders", **orders),
    }
    second = {
        "Items": TableSpec("Items", "ps_lineitem", "stg_lineitem", transformations=(few,), **items),
        "Customers": TableSpec("Customers", "ps_customer", "stg_customer", transformations=(debt,), **customers),
        "Suppliers": TableSpec("Suppliers", "ps_supplier", "stg_supplier", **suppliers),
        "Orders": TableSpec("Orders", "ps_orders", "stg_orders", transformations=ORDER_RULES, **orders),
    }
    third = {
        "Items": TableSpec("Items", "stg_lineitem", "fact_lineitem", dim_type="Fact", lookups=lookups, **items),
        "Customers": TableSpec(
            "Customers", "stg_customer", "dim_customer", target_filter="IsCurrent = 1", dim_type="Type2", surrogate_key="CustomerSK", **customers
        ),
        "Suppliers": TableSpec("Suppliers", "stg_supplier", "dim_supplier", dim_type="Type1", surrogate_key="SupplierSK", **suppliers),
        "Orders": TableSpec("Orders", "stg_orders", "dim_orders", dim_type="Type1", surrogate_key="OrderSK", **orders),
    }
    layers = [
        LayerSpec(L1, "source", "prestaging", first, direct_move=True),
        LayerSpec(L2, "prestaging", "staging", second, valid_filter="IsValid = 1", tolerate_missing_in_target=True),
        LayerSpec(L3, "staging", "dwh", third, source_valid_filter="IsValid = 1"),
    ]
    return PipelineSpec(layers={layer.name: layer for layer in layers})


def reload_sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Sources of the reload; the orders have defects."""
    found = {name: given(spark, sf_dir, name) for name in ("customer", "supplier", "lineitem")}
    return {**found, "orders": orders_target(given(spark, sf_dir, "orders"))}


def orders_fact(stg_orders: DataFrame, dimension: DataFrame) -> DataFrame:
    """Accepted orders with the surrogate key of the current customer version, some of them with a changed price."""
    current = dimension.where("IsCurrent = 1")
    keyed = lookup(stg_orders.where("IsValid = 1"), "o_custkey", current, "c_custkey", {"CustomerSK": "CustomerSK"})
    return keyed.selectExpr(
        "o_orderkey",
        "o_orderstatus",
        "if(o_orderkey % 211 = 0, o_totalprice * 2, o_totalprice) as o_totalprice",
        "o_orderdate",
        "lower(o_orderpriority) as o_orderpriority",
        "CustomerSK",
    )


def store(spark: SparkSession, sf_dir: str) -> TableStore:
    """The tables of all layers, each built when it is used.

    Loaded tables are written to the shared checkpoint folder, as the loads of a warehouse write them: the
    checks that read a table several times do not run its load again.
    """
    found, spec = TableStore(spark), pipeline()

    def table(logical_db: str, name: str) -> DataFrame:
        return found.table(logical_db, name)

    built = {
        ("source", "orders"): lambda: given(spark, sf_dir, "orders"),
        ("source", "customer"): lambda: given(spark, sf_dir, "customer"),
        ("prestaging", "ps_orders"): lambda: orders_target(table("source", "orders")),
        ("prestaging", "ps_customer"): lambda: load_direct(table("source", "customer")),
        ("staging", "stg_orders"): lambda: materialised(
            load_staging(table("prestaging", "ps_orders"), spec.table(L2, "Orders"))
        ),
        ("staging", "stg_customer"): lambda: table("source", "customer").withColumn(
            "IsValid", F.expr("if(c_custkey % 13 = 0, 0, 1)")
        ),
        ("dwh", "dim_customer"): lambda: customer_dimension(table("source", "customer")),
        ("dwh", "fact_orders"): lambda: materialised(
            orders_fact(table("staging", "stg_orders"), table("dwh", "dim_customer"))
        ),
    }
    for (logical_db, name), build in built.items():
        found.register(logical_db, name, build)
    return found
