"""A small bank, built by rule: 5 branches, 10 customers, 10 accounts, 20 transactions in the shape of FIXTURES.md."""

from __future__ import annotations

from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tallymark.operators.defects import Defect, inject_defects
from tallymark.spec import PipelineSpec, load_pipeline

FOLDER = Path(__file__).parent / "bank"
LOADED_ON = datetime(2024, 1, 1)


def bank_pipeline() -> PipelineSpec:
    return load_pipeline(FOLDER / "settings.yaml", *[FOLDER / f"layer{n}.yaml" for n in (1, 2, 3)])


def golden_sources(spark: SparkSession) -> dict[str, DataFrame]:
    """Clean rows with the traits that matter: mixed case, an ancient birth date, open accounts without close date."""
    places = "element_at(array('Delhi', 'Mumbai', 'Kolkata', 'Hyderabad', 'Bengaluru'), cast(id % 5 as int) + 1)"
    created = "timestamp_ntz'2023-01-01 09:00:00' + make_dt_interval(cast(id as int)) as CreatedDate"
    branches = spark.range(1, 6).selectExpr(
        "cast(100 + id as int) as BranchID", "format_string('BR%03d', id) as BranchCode",
        f"concat({places}, ' Branch') as BranchName", f"{places} as City", "'State' as StateName",
        "'India' as Country", "concat('Manager ', id) as ManagerName", created,
        "cast(null as timestamp_ntz) as UpdatedDate",
    )
    customers = spark.range(1, 11).selectExpr(
        "cast(id as int) as CustomerID", "format_string('CUST%04d', id) as CustomerCode",
        "concat('Customer Nr ', id) as CustomerName",
        "if(id = 2, date'1092-08-25', add_months(date'1980-04-12', cast(id as int) * 7)) as DOB",
        "if(id % 2 = 0, 'Female', 'Male') as Gender", "concat('Customer.', id, '@Email.com') as Email",
        "cast(9876543210 + id as string) as Phone", "concat(id, ' MG Road') as AddressLine", f"{places} as City",
        "'State' as StateName", "'India' as Country", created, "cast(null as timestamp_ntz) as UpdatedDate",
    )
    accounts = spark.range(1, 11).selectExpr(
        "cast(1000 + id as int) as AccountID", "format_string('AC%010d', 1000 + id) as AccountNumber",
        "cast(id as int) as CustomerID", "if(id % 3 = 0, 'Current', 'Savings') as AccountType",
        "date_add(date'2023-01-10', cast(id as int)) as OpenDate", "cast(null as date) as CloseDate",
        "'Active' as Status", "cast(id * 1234.25 as decimal(18,2)) as Balance", "'INR' as CurrencyCode", created,
        "cast(null as timestamp_ntz) as UpdatedDate",
    )
    transactions = spark.range(1, 21).selectExpr(
        "cast(50000 + id as int) as TransactionID", "format_string('TXN%012d', id) as TransactionNumber",
        "cast(1001 + (id - 1) % 10 as int) as AccountID", "cast(101 + (id - 1) % 5 as int) as BranchID",
        "timestamp_ntz'2023-04-01 10:00:00' + make_dt_interval(0, cast(id as int)) as TransactionDate",
        "if(id <= 10, 'Credit', 'Debit') as TransactionType", "cast(id * 100.5 as decimal(18,2)) as Amount",
        "'INR' as CurrencyCode", "concat('Payment ', id) as Description", created,
    )
    return {
        "dbo.SRC_Branches": branches,
        "dbo.SRC_Customers": customers,
        "dbo.SRC_Accounts": accounts,
        "dbo.SRC_Transactions": transactions,
    }


DEFECTS = {
    "dbo.SRC_Branches": [
        Defect("BranchID = 102", "BranchName", "concat('  ', BranchName, '  ')", "name is padded"),
        Defect("BranchID = 103", "Country", "lower(Country)", "lower-case country", negative=False),
    ],
    "dbo.SRC_Customers": [
        Defect("CustomerID = 2", "CustomerName", "concat('  ', CustomerName, '  ')", "name is padded"),
        Defect("CustomerID = 3", "Email", "'not-an-email'", "e-mail is invalid"),
        Defect("CustomerID = 6", "Gender", "'X'", "gender is unknown"),
    ],
    "dbo.SRC_Accounts": [
        Defect("AccountID = 1003", "Status", "'FROZEN'", "status is unknown"),
        Defect("AccountID = 1003", "CurrencyCode", "'US'", "currency is too short"),
        Defect("AccountID = 1005", "AccountNumber", "concat('  ', AccountNumber)", "number is padded"),
    ],
    "dbo.SRC_Transactions": [
        Defect("TransactionID = 50004", "TransactionType", "'REFUND'", "type is unknown"),
        Defect("TransactionID = 50005", "Amount", "-100.00", "amount is negative"),
    ],
}


def negative_sources(spark: SparkSession) -> dict[str, DataFrame]:
    """The golden rows with ten defects in eight rows."""
    return {name: inject_defects(df, DEFECTS[name]) for name, df in golden_sources(spark).items()}
