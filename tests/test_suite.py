"""Checks, runs, reports and loads over the small bank, end to end."""

from __future__ import annotations

import pytest
from bank_data import LOADED_ON, bank_pipeline, golden_sources, negative_sources
from conftest import rows_of

from tallymark.operators.loads import load_order, reload_layers
from tallymark.plans import catalogue, checks, results
from tallymark.plans.checks import CheckContext, check, check_results
from tallymark.plans.failures import comparison_records, failure_records
from tallymark.plans.mapping import mapping_document
from tallymark.plans.suite import run_suite
from tallymark.plans.tickets import findings, tickets
from tallymark.sources.tables import TableStore
from tallymark.spec import LayerSpec, PipelineSpec, TableSpec, layer_from_dict, split_table_name


@pytest.fixture(scope="module")
def golden(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("golden")
    return reload_layers(spark, bank_pipeline(), golden_sources(spark), str(root), LOADED_ON)


@pytest.fixture(scope="module")
def negative(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("negative")
    sources = {name: df.drop("_note") for name, df in negative_sources(spark).items()}
    return reload_layers(spark, bank_pipeline(), sources, str(root), LOADED_ON)


def failed(run) -> list[tuple]:
    rows = run.results.where("status <> 'PASS'").orderBy("seq").collect()
    return [(r["layer"], r["table"], r["validation"], r["message"]) for r in rows]


def test_spec_lookup_errors():
    spec = bank_pipeline()
    with pytest.raises(ValueError, match="Unknown layer 'Nope'"):
        spec.layer("Nope")
    with pytest.raises(ValueError, match="Table 'Nope' not found in layer 'StagingToDWH'"):
        spec.table("StagingToDWH", "Nope")
    with pytest.raises(ValueError, match="Unknown setting"):
        layer_from_dict({"layer": "X", "source_db": "a", "target_db": "b", "surprise": 1})
    assert split_table_name("Accounts") == ("dbo", "Accounts")
    assert [t.name for t in load_order(spec.layer("StagingToDWH"))][-1] == "Transactions"


def test_filters_per_layer():
    spec = bank_pipeline()
    found = {}
    for name in spec.layers:
        f = spec.layer(name).filters(spec.table(name, "Branches"))
        found[name] = (f.source, f.target, f.count_source, f.count_target)
    assert found == {
        "SourceToPreStaging": (None, None, None, None),
        "PreStagingToStaging": (None, "IsValid = 1", None, None),
        "StagingToDWH": ("IsValid = 1", "IsCurrent = 1", "IsValid = 1", "IsCurrent = 1"),
    }


def test_clean_data_passes_everything(spark, golden):
    run = run_suite(golden, bank_pipeline())
    assert failed(run) == []
    assert tuple(results.summary_counts(run.results).first()) == (78, 78, 0, 0, 78, 100.0, "PASSED")
    assert rows_of(results.summary_by_layer(run.results)) == [
        ("PreStagingToStaging", 28, 0, 0), ("SourceToPreStaging", 24, 0, 0), ("StagingToDWH", 26, 0, 0),
    ]
    fact = golden.table("dwh", "dbo.FactTransaction")
    assert fact.columns == [
        "TransactionID", "TransactionNumber", "TransactionType", "Amount", "CurrencyCode", "TransactionDate",
        "AccountSK", "BranchSK", "CustomerSK",
    ]
    assert fact.where("AccountSK is null or BranchSK is null or CustomerSK is null").count() == 0


def test_rejected_rows_stay_in_staging(spark, negative):
    run = run_suite(negative, bank_pipeline())
    rejected = negative.table("staging", "dbo.STG_Transactions").where("IsValid = 0")
    assert rows_of(rejected.select("TransactionID", "RejectionReason")) == [
        (50004, "Transaction type must be a known value"), (50005, "Transaction amount must not be negative"),
    ]
    assert negative.table("staging", "dbo.STG_Accounts").where("IsValid = 0").count() == 1
    # rejected parents leave facts without surrogate keys: two of account 1003, two of customer 6
    assert failed(run) == [
        (
            "StagingToDWH",
            "Transactions",
            checks.FOREIGN_KEY,
            "FK problems -> AccountSK: 2 null(s); CustomerSK: 4 null(s)",
        )
    ]


def test_defects_between_layers_are_reported(spark, golden):
    spec = bank_pipeline()
    store = TableStore(spark)
    ps = golden.table("prestaging", "dbo.PS_Accounts")
    broken = ps.where("AccountID <> 1007").selectExpr(
        *[c if c not in ("Balance", "OpenDate") else
          f"if(AccountID = 1002, {'Balance + 1' if c == 'Balance' else 'date_add(OpenDate, 1)'}, {c}) as {c}"
          for c in ps.columns]
    )
    broken = broken.unionByName(broken.where("AccountID = 1010")).withColumn("Balance", broken["Balance"].cast("decimal(18,2)"))
    store.register("source", "dbo.SRC_Accounts", golden.table("source", "dbo.SRC_Accounts"))
    store.register("prestaging", "dbo.PS_Accounts", broken)
    layer = spec.layer("SourceToPreStaging")
    only = LayerSpec(layer.name, layer.source_db, layer.target_db, {"Accounts": layer.table("Accounts")}, direct_move=True)
    hint = {("SourceToPreStaging", "Accounts"): "May be a demo."}
    pipeline = PipelineSpec({layer.name: only}, spec.databases, known_defects=hint)
    run = run_suite(store, pipeline, keep_issues=True)
    assert [f[2:] for f in failed(run)] == [
        (checks.DUPLICATE, "1 duplicate key group(s) on ['AccountID']"),
        (checks.CONSTRAINT, "1 duplicate key group(s)"),
        (checks.DIRECT_MOVE, "diffs=2, missing_in_target=1, missing_in_source=0, duplicates=2"),
    ]
    records = failure_records(run, "Accounts")
    assert {r["validation"] for r in records.collect()} == {checks.DIRECT_MOVE}
    assert [(r["failure_type"], r["row_destination"], r["AccountID"], r["highlight"][:2]) for r in records.collect()] == [
        ("DF", "Source", "1002", ["OpenDate", "Balance"]),
        ("DF", "Target", "1002", ["OpenDate", "Balance"]),
        ("Missing in Target", "Source", "1007", ["AccountID", "AccountNumber"]),
        ("Duplicate in Target", "Target", "1010", ["AccountID", "AccountNumber"]),
        ("Duplicate in Target", "Target", "1010", ["AccountID", "AccountNumber"]),
    ]
    assert failure_records(run, "Accounts", max_rows=2).count() == 2
    raised = tickets(run).orderBy("DefectID").collect()
    assert [(t["DefectID"], t["Defect Type"], t["Severity"]) for t in raised] == [
        ("DEF_001", "Duplicate Business Key", "Medium"),
        ("DEF_002", "Constraint Violation", "High"),
        ("DEF_003", "Column Value Mismatch", "High"),
        ("DEF_004", "Column Value Mismatch", "High"),
        ("DEF_005", "Missing Record in Target", "High"),
        ("DEF_006", "Duplicate Record", "High"),
    ]
    assert raised[0]["Actual Result"] == "Duplicate key(s) in target: 1010 (x2)"
    assert raised[2]["Title"] == "SourceToPreStaging / Accounts: OpenDate value differs at [AccountID=1002]"
    assert raised[2]["Actual Result"] == (
        "[AccountID=1002] Column 'OpenDate' -> Source dbo.SRC_Accounts(Bank_Source) = '2023-01-12'  |  "
        "Target dbo.PS_Accounts(Bank_PreStaging) = '2023-01-13'"
    )
    assert raised[2]["Probable Root Cause"].endswith("(it changed during the movement). May be a demo.")
    assert raised[4]["Actual Result"].split("\n")[1].startswith("Source row: AccountID=1007 | AccountNumber='AC0000001007'")
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == 0


def test_tolerated_rows_raise_tickets_only_on_request(spark, negative):
    run = run_suite(negative, bank_pipeline(), only=["prestaging_to_staging"])
    assert findings(run).count() == 0
    assert findings(run, include_tolerated=True).where("type = 'Missing Record in Target'").count() == 5


def test_selection_and_gate(spark, golden):
    spec = bank_pipeline()
    run = run_suite(golden, spec, only=["count_check", "fact"])
    counted = {r["status"]: r["count"] for r in run.results.groupBy("status").count().collect()}
    assert counted == {"PASS": 11 + 8, "SKIP": 78 - 19}
    reason = run.results.where("status = 'SKIP'").select("message", "category").distinct().collect()
    assert [tuple(r) for r in reason] == [("Skipped because marker not in --only=count_check or fact", "skipped")]
    ordered = [r["status"] for r in results.ordered_results(run.results).collect()]
    assert ordered == sorted(ordered)

    def broken_gate():
        raise RuntimeError("reload failed")

    for gate, message in ((broken_gate, "reload failed"), (lambda: (False, "exit code = 1"), "exit code = 1")):
        gated = run_suite(golden, spec, gate=gate)
        assert tuple(results.summary_counts(gated.results).first())[:5] == (79, 0, 1, 78, 1)
        assert gated.results.where("status = 'FAIL'").first()["message"] == message
        assert not gated.contexts
    assert run_suite(golden, spec, only=["metadata_check"], gate=lambda: (True, "ok")).results.count() == 79


def test_checks_that_cannot_run_are_errors(spark, golden):
    store = TableStore(spark)
    spec = bank_pipeline()
    for name in ("Branches",):
        table = spec.table("SourceToPreStaging", name)
        store.register("source", table.source_table, golden.table("source", table.source_table))
        store.register("prestaging", table.target_table, golden.table("prestaging", table.target_table).drop("BranchCode"))
    layer = spec.layer("SourceToPreStaging")
    pipeline = PipelineSpec({layer.name: LayerSpec(layer.name, "source", "prestaging", {"Branches": layer.table("Branches")}, direct_move=True)})
    run = run_suite(store, pipeline)
    statuses = {r["validation"]: r["status"] for r in run.results.collect()}
    assert statuses == {
        checks.METADATA: "FAIL", checks.COUNT: "PASS", checks.DUPLICATE: "PASS", checks.NULL: "ERROR",
        checks.CONSTRAINT: "PASS", checks.DIRECT_MOVE: "ERROR",
    }
    totals = results.run_totals(run.results).first()
    assert tuple(totals)[:5] == (6, 3, 3, 2, 0) and totals["duration"] > 0
    assert results.failures(run.results).count() == 3 and results.executed(run.results).count() == 6


def test_single_checks(spark, golden):
    spec = bank_pipeline()
    ctx = CheckContext.of(golden, spec, "StagingToDWH", "Transactions")
    row = check(ctx, checks.FOREIGN_KEY).first()
    assert row["status"] == "PASS" and row["category"] == "foreign_key"
    assert row["message"] == "all foreign keys valid (AccountSK, BranchSK, CustomerSK)"
    no_rules = check(CheckContext.of(golden, spec, "SourceToPreStaging", "Accounts"), checks.TRANSFORMATION).first()
    assert no_rules["message"] == "no transformation rules configured" and no_rules["metrics"] is None
    with pytest.raises(ValueError, match="Unknown check"):
        check_results(ctx, ["nope"])
    checks.register_check(
        "Row_Limit", lambda c, m: checks.Outcome(f"{m.target_count()} < 10", f"concat('rows=', {m.target_count()})")
    )
    assert check(ctx, "Row_Limit").first()["message"] == "rows=20"


def test_catalogue(spark):
    cases = catalogue.check_catalogue(spark, bank_pipeline())
    assert cases.count() == 76
    assert rows_of(cases.groupBy("Layer").count()) == [
        ("PreStagingToStaging", 28), ("SourceToPreStaging", 24), ("StagingToDWH", 24),
    ]
    first = cases.where("TestCaseID = 'TC_PSSTG_ACC_007'").first()
    assert first["Suggested Validation"] == checks.TRANSFORMATION and first["Priority"] == "Medium"
    assert first["Column(s)"] == "CurrencyCode, AccountNumber, Status"
    chosen = catalogue.select_by_tags(cases, ["null_check"])
    assert chosen.where("action = 'RUN'").count() == 12
    assert catalogue.first_cases(cases.unionByName(cases)).count() == 76


def test_mapping_document(spark, golden):
    spec = bank_pipeline()
    rows = {}
    for layer in spec.layers:
        for r in mapping_document(golden, spec, layer).collect():
            rows[layer, r["Target Table Name"], r["Target Column Name"]] = r
    key = rows["SourceToPreStaging", "dbo.PS_Accounts", "AccountID"]
    assert key["Source Constraints"] == "PK, NOT NULL" and key["Target Constraints"] == "Business Key, NOT NULL"
    assert key["Source DB Name"] == "Bank_Source" and key["Source Size"] == "10"
    customer = rows["SourceToPreStaging", "dbo.PS_Accounts", "CustomerID"]
    assert customer["Source Constraints"] == "FK -> dbo.SRC_Customers, NOT NULL"

    def rule(*at):
        return rows[at]["Transformation Rule"]

    staging, dwh = "PreStagingToStaging", "StagingToDWH"
    assert rule(staging, "dbo.STG_Customers", "Gender") == "Gender must be standardised to upper-case"
    assert rule(staging, "dbo.STG_Customers", "IsValid").startswith("Validity flag")
    assert rule(staging, "dbo.STG_Customers", "CreatedDate") == "Populated by load procedure (audit column)"
    assert rule(staging, "dbo.STG_Customers", "City").startswith("Cleaned & standardised")
    assert rule(dwh, "dbo.FactTransaction", "AccountSK") == "Surrogate key generated in the warehouse"
    assert rule(dwh, "dbo.DimBranch_Type2", "ExpiryDate").startswith("SCD control column")
    assert rule(dwh, "dbo.DimAccount_Type1", "Balance").startswith("Type-1 dimension load")
    assert rows[dwh, "dbo.FactTransaction", "AccountSK"]["Source Column Name"] == ""
    offline = mapping_document(TableStore(spark), spec, "SourceToPreStaging").collect()
    assert len(offline) == 7 + 11 + 9 + 9 and {r["Target Data Type"] for r in offline} == {"n/a"}


def test_second_load_keeps_history(spark, golden, tmp_path):
    from datetime import datetime

    sources = golden_sources(spark)
    sources["dbo.SRC_Branches"] = sources["dbo.SRC_Branches"].selectExpr(
        "*", "if(BranchID = 101, 'Noida', City) as NewCity"
    ).drop("City").withColumnRenamed("NewCity", "City")
    again = reload_layers(spark, bank_pipeline(), sources, str(tmp_path), datetime(2024, 2, 1), previous=golden)
    branch = again.table("dwh", "dbo.DimBranch_Type2").where("BranchID = 101")
    assert rows_of(branch.select("City", "IsCurrent", "BranchSK")) == [("MUMBAI", 0, 1), ("NOIDA", 1, 6)]
    assert failed(run_suite(again, bank_pipeline())) == []


def test_records_of_tables_with_different_columns(spark):
    store = TableStore(spark)
    store.register("a", "t", spark.sql("select 1 as id, 'x' as v, 5 as extra"))
    store.register("b", "t", spark.sql("select 1 as id, 'y' as v"))
    table = TableSpec("T", "t", "t", ("id",), ("v",))
    ctx = CheckContext(store, LayerSpec("L", "a", "b", {"T": table}), table)
    c = ctx.comparison(checks.INTEGRITY)
    assert rows_of(comparison_records(c, "L").select("layer", "row_destination", "v")) == [
        ("L", "Source", "x"), ("L", "Target", "y"),
    ]
