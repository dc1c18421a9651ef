"""Equivalent SQL of the registered queries, over the given tables only.

Written independently of the library: joins and windows where the library aggregates, so that an agreement means
something. Comparisons follow the usual shape: number the rows of each side by key, full-join the first ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from tallymark import fixed_values as fixed

ORDER_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
ORDER_VALUES = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
CUSTOMER_VALUES = ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
NUMBERS = {"o_custkey", "o_totalprice", "c_nationkey", "c_acctbal", "l_partkey", "l_quantity"}
DATES = {"o_orderdate"}
L1, L2, L3 = "SourceToPreStaging", "PreStagingToStaging", "StagingToDWH"

# ---- derived tables ----------------------------------------------------------------------------------------------

PS_ORDERS = f"""
ps_base as (
  select case when o_orderkey % 103 = 0 then o_orderkey + 100000000 else o_orderkey end as o_orderkey,
         case when o_orderkey % 73 = 0 then null else o_custkey end as o_custkey,
         case when o_orderkey % 79 = 0 then lower(o_orderstatus) else o_orderstatus end as o_orderstatus,
         case when o_orderkey % 89 = 0 then o_totalprice + 1.0::double
              when o_orderkey % 71 = 0 then o_totalprice + 1e-10::double else o_totalprice end as o_totalprice,
         o_orderdate,
         case when o_orderkey % 83 = 0 then '  ' || o_orderpriority || ' '
              when o_orderkey % 67 = 0 then '' else o_orderpriority end as o_orderpriority,
         o_orderkey as ok
  from orders where o_orderkey % 97 <> 0),
ps_orders as (
  select {ORDER_COLUMNS} from ps_base
  union all
  select {ORDER_COLUMNS} from ps_base where ok % 101 = 0)"""

PS_CUSTOMER = "ps_customer as (select * from customer)"

STG_ORDERS = """
stg_clean as (
  select o_orderkey, o_custkey, upper(trim(o_orderstatus)) as o_orderstatus, o_totalprice, o_orderdate,
         upper(trim(o_orderpriority)) as o_orderpriority
  from ps_orders),
stg_judged as (
  select *, concat_ws('; ',
      case when o_orderkey is null then 'o_orderkey is missing' end,
      case when o_custkey is null then 'o_custkey is missing' end,
      case when o_orderstatus not in ('F', 'O', 'P') then 'Status must be a known upper-case value' end,
      case when o_orderpriority <> trim(o_orderpriority) then 'Priority must be trimmed' end,
      case when not regexp_matches(o_orderpriority, '^[1-5]-') then 'Priority must start with its number' end,
      case when o_totalprice < 2000 then 'Price must be at least 2000' end) as bad
  from stg_clean),
stg_ranked as (
  select *, row_number() over (partition by o_orderkey order by bad <> '', o_custkey nulls first, o_orderstatus,
                               o_totalprice, o_orderdate, o_orderpriority) as rn
  from stg_judged),
stg_reasons as (
  select *, concat_ws('; ', nullif(bad, ''), case when rn > 1 then 'Duplicate business key' end) as reason
  from stg_ranked),
stg_orders as (
  select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
         case when reason = '' then 1 else 0 end as "IsValid", nullif(reason, '') as "RejectionReason"
  from stg_reasons)"""

STG_CUSTOMER = "stg_customer as (select *, case when c_custkey % 13 = 0 then 0 else 1 end as \"IsValid\" from customer)"

DIM_CUSTOMER = """
dim_customer as (
  select c_custkey * 10 + cur as "CustomerSK", c_custkey, upper(c_name) as c_name, c_nationkey,
         case when c_custkey % 11 = 0 or cur = 0 then c_acctbal - 1.0::double else c_acctbal end as c_acctbal,
         c_mktsegment, cur as "IsCurrent"
  from customer, (values (0), (1)) as v(cur)
  where c_custkey % 50 <> 0 and (cur = 1 or c_custkey % 10 = 0))"""

FACT_ORDERS = """
fact_orders as (
  select o_orderkey, o_orderstatus,
         case when o_orderkey % 211 = 0 then o_totalprice * 2 else o_totalprice end as o_totalprice,
         o_orderdate, lower(o_orderpriority) as o_orderpriority, d."CustomerSK"
  from stg_orders s left join (select * from dim_customer where "IsCurrent" = 1) d on s.o_custkey = d.c_custkey
  where "IsValid" = 1)"""

ALL_LAYERS = [PS_ORDERS, PS_CUSTOMER, STG_ORDERS, STG_CUSTOMER, DIM_CUSTOMER, FACT_ORDERS]


def with_(ctes: Sequence[str], select: str) -> str:
    return f"with {', '.join(ctes)}\n{select}" if ctes else select


# ---- comparison --------------------------------------------------------------------------------------------------


def _unequal(column: str, insensitive: bool) -> str:
    s, t = f's."{column}"', f't."{column}"'
    if column in NUMBERS:
        return f"(({s} is null) <> ({t} is null) or coalesce(abs({s}::double - {t}::double) >= 1e-9, false))"
    if column in DATES:
        return f"{s} is distinct from {t}"
    a, b = f"nullif(trim({s}), '')", f"nullif(trim({t}), '')"
    return f"lower({a}) is distinct from lower({b})" if insensitive else f"{a} is distinct from {b}"


def compared(
    name: str, source: str, target: str, keys: Sequence[str], columns: Sequence[str], insensitive: bool = False
) -> str:
    """CTEs ``<name>_s``, ``<name>_t`` (numbered rows) and ``<name>`` (joined first rows with flags)."""
    key_list = ", ".join(keys)
    order = ", ".join(f'"{c}" nulls first' for c in [*columns, *keys])

    def side(suffix: str, rows: str) -> str:
        return (
            f"{name}_{suffix} as (select *, row_number() over (partition by {key_list} order by {order}) as rn, "
            f"count(*) over (partition by {key_list}) as n from {rows})"
        )

    on = " and ".join(f"s.{k} = t.{k}" for k in keys)
    flags = ", ".join(f"({_unequal(c, insensitive)}) as d{i}" for i, c in enumerate(columns))
    k = keys[0]
    pairs = (
        f"{name} as (select s as s, t as t, s.{k} is not null as in_s, t.{k} is not null as in_t, "
        f"coalesce(s.n, 0) as n_s, coalesce(t.n, 0) as n_t, {flags} "
        f"from (select * from {name}_s where rn = 1) s full join (select * from {name}_t where rn = 1) t on {on})"
    )
    return ",\n".join([side("s", source), side("t", target), pairs])


def _counts(name: str, n: int) -> str:
    cells = " + ".join(f"d{i}::int" for i in range(n))
    return (
        f"select coalesce(sum(case when in_s and in_t then {cells} else 0 end), 0)::bigint as diffs, "
        f"(count(*) filter (in_s and in_t and {cells} > 0))::bigint as differing_rows, "
        "(count(*) filter (in_s and not in_t))::bigint as missing_in_target, "
        "(count(*) filter (in_t and not in_s))::bigint as missing_in_source, "
        "coalesce(sum(case when n_s > 1 then n_s else 0 end + case when n_t > 1 then n_t else 0 end), 0)::bigint "
        f"as duplicates from {name}"
    )


ORDERS_SENSITIVE = [PS_ORDERS, compared("c", "orders", "ps_orders", ["o_orderkey"], ORDER_VALUES)]
ORDERS_INSENSITIVE = [PS_ORDERS, compared("c", "orders", "ps_orders", ["o_orderkey"], ORDER_VALUES, True)]


def _cell_diffs(values_as_text: bool = True) -> str:
    parts = []
    for i, c in enumerate(ORDER_VALUES):
        parts.append(
            f"select s.o_orderkey, '{c}' as \"column\", s.{c}::varchar as source_value, t.{c}::varchar as target_value "
            f"from c where in_s and in_t and d{i}"
        )
    return "\nunion all ".join(parts)


# ---- check results -----------------------------------------------------------------------------------------------


def _result(
    layer: str, table: str, validation: str, passed: str, message: str, source: str, seq: int = 0, category: str = "basic"
) -> str:
    return (
        f"select {seq} as seq, '{layer}' as layer, '{table}' as \"table\", '{validation}' as validation, "
        f"'{category}' as category, case when {passed} then 'PASS' else 'FAIL' end as status, "
        f"{message} as message from ({source})"
    )


def _quote(text: str) -> str:
    return text.replace("'", "''")


class Check:
    """Result-row SELECTs of one table."""

    def __init__(self, layer: str, table: str, source: str, target: str, keys: Sequence[str], columns: Sequence[str],
                 required: Sequence[str], count_target: str | None = None) -> None:
        self.layer, self.table, self.source, self.target = layer, table, source, target
        self.keys, self.columns, self.required = keys, columns, required
        self.count_target = count_target or target
        self.tag = f"{layer}_{table}".lower()

    def _row(self, validation: str, passed: str, message: str, source: str, category: str = "basic") -> str:
        return _result(self.layer, self.table, validation, passed, message, source, 0, category)

    def metadata(self) -> str:
        n = len(dict.fromkeys([*self.keys, *self.columns]))
        text = f"'all {n} expected columns present on both sides'"
        return self._row("Metadata_Validation", "true", text, "select 1")

    def count(self) -> str:
        source = f"select (select count(*) from {self.source}) as s, (select count(*) from {self.count_target}) as t"
        return self._row("Count_Validation", "s = t", "'source=' || s || ', target=' || t || ', diff=' || (s - t)", source)

    def _groups(self) -> str:
        keys = ", ".join(self.keys)
        return f"(select count(*) from (select {keys} from {self.target} group by {keys} having count(*) > 1))"

    def duplicate(self) -> str:
        names = _quote("[" + ", ".join(f"'{k}'" for k in self.keys) + "]")
        message = f"case when g = 0 then 'no duplicate keys' else g || ' duplicate key group(s) on {names}' end"
        return self._row("Duplicate_Validation", "g = 0", message, f"select {self._groups()} as g")

    def null(self) -> str:
        counts = ", ".join(f"count(*) filter ({c} is null) as n{i}" for i, c in enumerate(self.required))
        passed = " and ".join(f"n{i} = 0" for i in range(len(self.required)))
        found = ", ".join(f"case when n{i} > 0 then '{c}=' || n{i} end" for i, c in enumerate(self.required))
        message = (
            f"case when {passed} then 'no nulls in required columns' "
            f"else 'nulls found -> ' || concat_ws(', ', {found}) end"
        )
        return self._row("Null_Validation", passed, message, f"select {counts} from {self.target}")

    def constraint(self) -> str:
        counts = ", ".join(f"count(*) filter ({k} is null) as n{i}" for i, k in enumerate(self.keys))
        passed = " and ".join([f"n{i} = 0" for i in range(len(self.keys))] + ["g = 0"])
        found = [f"case when n{i} > 0 then '{k} has ' || n{i} || ' null(s)' end" for i, k in enumerate(self.keys)]
        found.append("case when g > 0 then g || ' duplicate key group(s)' end")
        message = (
            f"case when {passed} then 'key constraints OK (unique + not null)' "
            f"else concat_ws('; ', {', '.join(found)}) end"
        )
        source = f"select {counts}, {self._groups()} as g from {self.target}"
        return self._row("Constraint_Validation", passed, message, source)

    def cte(self, insensitive: bool, columns: Sequence[str] | None = None, suffix: str = "") -> str:
        return compared(self.tag + suffix, self.source, self.target, self.keys, columns or self.columns, insensitive)

    def _summary(self, suffix: str = "", columns: Sequence[str] | None = None) -> str:
        return _counts(self.tag + suffix, len(columns or self.columns))

    def exact(self, validation: str, category: str = "basic", suffix: str = "", columns: Sequence[str] | None = None) -> str:
        passed = "diffs + missing_in_target + missing_in_source + duplicates = 0"
        message = (
            "'diffs=' || diffs || ', missing_in_target=' || missing_in_target || ', missing_in_source=' || "
            "missing_in_source || ', duplicates=' || duplicates"
        )
        return self._row(validation, passed, message, self._summary(suffix, columns), category)

    def integrity(self, tolerated: bool = False) -> str:
        passed = "diffs + missing_in_source + duplicates" + ("" if tolerated else " + missing_in_target") + " = 0"
        message = (
            "'diffs=' || diffs || ', orphan_target=' || missing_in_source || ', duplicates=' || duplicates || "
            "', missing_in_target=' || missing_in_target" + (" || ' (tolerated)'" if tolerated else "")
        )
        return self._row("data_integrity_Validation", passed, message, self._summary())

    def transformation(self) -> str:
        rules = [
            ("o_orderstatus", "in_set", "o_orderstatus not in ('F', 'O', 'P')"),
            ("o_orderpriority", "no_whitespace", "o_orderpriority <> trim(o_orderpriority)"),
            ("o_orderpriority", "regex", "not regexp_matches(o_orderpriority, '^[1-5]-')"),
            ("o_totalprice", "min_value", "o_totalprice < 2000"),
        ]
        counts = ", ".join(f"count(*) filter ({r}) as n{i}" for i, (_, _, r) in enumerate(rules))
        passed = " and ".join(f"n{i} = 0" for i in range(len(rules)))
        found = ", ".join(f"case when n{i} > 0 then '{c}[{k}]=' || n{i} end" for i, (c, k, _) in enumerate(rules))
        listed = "; ".join(f"{c}:{k}" for c, k, _ in rules)
        message = (
            f"case when {passed} then 'all rules passed ({listed})' "
            f"else 'rule breaks -> ' || concat_ws(', ', {found}) end"
        )
        source = f"select {counts} from {self.target}"
        return self._row("Transformation_Validation", passed, message, source, "transformation")

    def base(self) -> list[str]:
        return [self.metadata(), self.count(), self.duplicate(), self.null(), self.constraint()]


def _foreign_key(layer: str, column: str, fact: str, ref: str, ref_column: str, null_aware: bool = False) -> str:
    missing = f"{column} not in (select {ref_column} from {ref})"
    if not null_aware:
        missing = f"not exists (select 1 from {ref} r where r.{ref_column} = f.{column})"
    source = (
        f"select count(*) filter ({column} is not null and {missing}) as o, count(*) filter ({column} is null) as n "
        f"from {fact} f"
    )
    if null_aware:
        source = f"select (select count(*) from {fact} where {column} is not null and {missing}) as o, 0 as n"
    else:
        source = (
            f"select (select count(*) from {fact} f where {column} is not null and {missing}) as o, "
            f"(select count(*) from {fact} where {column} is null) as n"
        )
    bare, table = column.strip('"'), ref
    message = (
        f"case when o = 0 and n = 0 then 'all foreign keys valid ({bare})' else 'FK problems -> ' || concat_ws('; ', "
        f"case when o > 0 then '{bare}: ' || o || ' orphan(s) not in {table}' end, "
        f"case when n > 0 then '{bare}: ' || n || ' null(s)' end) end"
    )
    return _result(layer, "Orders", "ForeignKey_Check", "o = 0 and n = 0", message, source, 0, "foreign_key")


C1 = Check(L1, "Customers", "customer", "ps_customer", ["c_custkey"], CUSTOMER_VALUES, ["c_custkey", "c_name"])
O1 = Check(L1, "Orders", "orders", "ps_orders", ["o_orderkey"], ORDER_VALUES, ["o_orderkey", "o_custkey"])
O2 = Check(
    L2, "Orders", "ps_orders", '(select * from stg_orders where "IsValid" = 1)', ["o_orderkey"], ORDER_VALUES,
    ["o_orderkey", "o_custkey"], "stg_orders",
)
C3 = Check(
    L3, "Customers", '(select * from stg_customer where "IsValid" = 1)',
    '(select * from dim_customer where "IsCurrent" = 1)', ["c_custkey"], CUSTOMER_VALUES, ["c_custkey", "c_name"],
)
FACT_VALUES = ["o_orderstatus", "o_totalprice", "o_orderpriority"]
O3 = Check(
    L3, "Orders", '(select * from stg_orders where "IsValid" = 1)', "fact_orders", ["o_orderkey"],
    ["o_orderstatus", "o_totalprice", "o_orderdate"], ["o_orderkey"],
)
ITEMS = Check(
    "Items", "Lineitem", "lineitem", "lineitem", ["l_orderkey", "l_linenumber"], [], ["l_orderkey", "l_linenumber"]
)
RAW = Check(L1, "Raw", "orders", "ps_orders", ["o_orderkey"], [], [])

COMPARISONS = [
    C1.cte(False), O1.cte(False), O2.cte(True), C3.cte(True), O3.cte(True), O3.cte(True, FACT_VALUES, "_values"),
]

FACT_KEY = _foreign_key(L3, '"CustomerSK"', "fact_orders", "dim_customer", '"CustomerSK"')

# every check of the run, in catalogue order
RUN = [
    *C1.base(), C1.exact("direct_move_Validation"),
    *O1.base(), O1.exact("direct_move_Validation"),
    *O2.base(), O2.integrity(tolerated=True), O2.transformation(),
    *C3.base(), C3.integrity(),
    *O3.base(), O3.integrity(), FACT_KEY,
    O3.exact("ColumnValues_Check", "value_check", "_values", FACT_VALUES),
]
RUN_NAMES = [(row.split("'")[1], row.split("'")[3], row.split("'")[5]) for row in RUN]


def _run(rows: Sequence[tuple[int, str]]) -> str:
    numbered = [row.replace("select 0 as seq", f"select {seq} as seq", 1) for seq, row in rows]
    return "\nunion all ".join(f"({row})" for row in numbered)


def _skipped(rows: Sequence[int], reason: str) -> str:
    values = ", ".join(
        f"({seq}, '{RUN_NAMES[seq][0]}', '{RUN_NAMES[seq][1]}', '{RUN_NAMES[seq][2]}')" for seq in rows
    )
    return (
        'select seq, layer, tbl as "table", validation, \'skipped\' as category, \'SKIP\' as status, '
        f"'{_quote(reason)}' as message from (values {values}) as v(seq, layer, tbl, validation)"
    )


FULL_RUN = [*ALL_LAYERS, *COMPARISONS]
_EVERY = list(enumerate(RUN))
_WITHOUT_NAME = (
    f"case when layer = '{L1}' and \"table\" = 'Customers' then case validation when 'Metadata_Validation' then 'FAIL' "
    "when 'Null_Validation' then 'ERROR' when 'direct_move_Validation' then 'ERROR' else status end else status end"
)
_COUNT_OR_FACT = [i for i, (layer, table, v) in enumerate(RUN_NAMES) if v == "Count_Validation" or (layer, table) == (L3, "Orders")]
_PLANNED = ("Count_Validation", "Duplicate_Validation", "Constraint_Validation")


def _chosen(rows: Sequence[int], only: str) -> str:
    others = [i for i in range(len(RUN)) if i not in rows]
    reason = fixed.SKIPPED_BY_SELECTION.format(only=only)
    return f"{_run([(i, RUN[i]) for i in rows])}\nunion all ({_skipped(others, reason)})"


def _summary(source: str) -> str:
    return (
        "select count(*) as total, count(*) filter (status = 'PASS') as passed, "
        "count(*) filter (status = 'FAIL') as failed, count(*) filter (status = 'SKIP') as skipped, "
        "count(*) filter (status <> 'SKIP') as executed, "
        "round(count(*) filter (status = 'PASS') * 100.0::double / count(*) filter (status <> 'SKIP'), 2) as pass_rate, "
        f"case when count(*) filter (status = 'FAIL') = 0 then 'PASSED' else 'FAILED' end as verdict from ({source})"
    )


# ---- failures, findings, tickets ---------------------------------------------------------------------------------


def _records(
    check: Check, number: int, label: str, columns: Sequence[str], validation: str, suffix_: str = "",
    own: Sequence[str] | None = None,
) -> str:
    """Failure records of one comparison."""
    own = list(own or check.columns)
    tag, n = check.tag + suffix_, len(own)
    label = f"{label}' as layer, '{validation}"
    cells = lambda row: ", ".join(
        f"{row}{c}::varchar as {c}" if c in [*check.keys, *own] else f"null as {c}" for c in columns
    )
    whole = ",".join([*check.keys, *own])
    differing = "concat_ws(',', " + ", ".join(f"case when d{i} then '{c}' end" for i, c in enumerate(own)) + ")"
    any_diff = " or ".join(f"d{i}" for i in range(n))
    parts = []
    for place, row in (("Source", "s."), ("Target", "t.")):
        parts.append(
            f"select {number} as l, 0 as k, '{label}' as validation, 'DF' as failure_type, '{place}' as row_destination, "
            f"{cells(row)}, {differing} as highlight from {tag} where in_s and in_t and ({any_diff})"
        )
    for k, place, row, ftype, where in (
        (1, "Source", "s.", "Missing in Target", "in_s and not in_t"),
        (2, "Target", "t.", "Missing in Source", "in_t and not in_s"),
    ):
        parts.append(
            f"select {number}, {k}, '{label}', '{ftype}', '{place}', {cells(row)}, '{whole}' from {tag} where {where}"
        )
    for place, suffix in (("Source", "s"), ("Target", "t")):
        parts.append(
            f"select {number}, 3, '{label}', 'Duplicate in {place}', '{place}', {cells('')}, '{whole}' "
            f"from {tag}_{suffix} where n > 1"
        )
    return "\nunion all ".join(parts)


_RECORD_COLUMNS = ["o_orderkey", *ORDER_VALUES]
_LABELS = list(fixed.LAYER_LABELS.values())
FAILURE_RECORDS = (
    f"select layer, validation, failure_type, row_destination, {', '.join(_RECORD_COLUMNS)}, highlight from ("
    + "\nunion all ".join(
        [
            _records(O1, 0, _LABELS[0], _RECORD_COLUMNS, "direct_move_Validation"),
            _records(O2, 1, _LABELS[1], _RECORD_COLUMNS, "data_integrity_Validation"),
            _records(O3, 2, _LABELS[2], _RECORD_COLUMNS, "data_integrity_Validation"),
            _records(O3, 2, _LABELS[2], _RECORD_COLUMNS, "ColumnValues_Check", "_values", FACT_VALUES),
        ]
    )
    + ")"
)


def _detail_records(most: int) -> str:
    """The first failure records of each table, with their number."""
    records = {
        "Customers": (
            ["c_custkey"],
            [
                _records(C1, 0, _LABELS[0], ["c_custkey"], "direct_move_Validation"),
                _records(C3, 2, _LABELS[2], ["c_custkey"], "data_integrity_Validation"),
            ],
        ),
        "Orders": (
            ["o_orderkey"],
            [
                _records(O1, 0, _LABELS[0], ["o_orderkey"], "direct_move_Validation"),
                _records(O2, 1, _LABELS[1], ["o_orderkey"], "data_integrity_Validation"),
                _records(O3, 2, _LABELS[2], ["o_orderkey"], "data_integrity_Validation"),
                _records(O3, 2, _LABELS[2], ["o_orderkey"], "ColumnValues_Check", "_values", FACT_VALUES),
            ],
        ),
    }
    every = "\nunion all ".join(
        f"select l, k, layer, validation, '{table}' as \"table\", failure_type, row_destination, {key[0]} as key, highlight from ("
        + "\nunion all ".join(parts)
        + ")"
        for table, (key, parts) in records.items()
    )
    return (
        'select layer, "table", validation, failure_type, row_destination, key, highlight, rank, total, '
        f"greatest(0, total - {most}) as left_out from (select *, count(*) over (partition by \"table\") as total, "
        'row_number() over (partition by "table" order by l, k, key, row_destination, validation) as rank '
        f"from ({every})) where rank <= {most}"
    )


def _duplicate_message(name: str, rows: str, keys: Sequence[str], first: int = 5) -> str:
    by = ", ".join(keys)
    text = "'(' || " + " || ', ' || ".join(f"coalesce({k}::varchar, 'NULL')" for k in keys) + " || ') x' || n"
    order = ", ".join(f"{k} nulls first" for k in keys)
    return (
        f"select '{name}' as table_name, count(*) as duplicate_groups, coalesce(sum(n - 1), 0)::bigint as surplus_rows, "
        f"case when count(*) = 0 then 'no duplicate keys' else count(*) || ' duplicate key group(s) on {_quote(str(list(keys)))}: ' "
        f"|| string_agg(text, '; ' order by place) filter (place <= {first}) "
        f"|| case when count(*) > {first} then '; and ' || (count(*) - {first}) || ' more' else '' end end as message "
        f"from (select *, {text} as text, row_number() over (order by {order}) as place "
        f"from (select {by}, count(*) as n from {rows} group by {by}) where n > 1)"
    )


def _row_text(row: str, columns: Sequence[str]) -> str:
    def cell(c: str) -> str:
        value = f"{row}{c}::varchar" if c in NUMBERS | {"o_orderkey", "c_custkey"} else f"'''' || {row}{c} || ''''"
        if c in DATES:
            value = f"strftime({row}{c}, '%Y-%m-%d %H:%M:%S')"
        return f"'{c}=' || coalesce({value}, 'None')"

    return "concat_ws(' | ', " + ", ".join(cell(c) for c in columns) + ")"


def _compared_rows(
    q: int, check: Check, validation: str, st: str, tt: str, sdb: str, tdb: str, suffix: str = "",
    columns: Sequence[str] | None = None, tolerated: bool = False,
) -> list[str]:
    """The findings of one comparison: differing cells, missing rows both ways, duplicated keys."""
    columns, pk, tag = list(columns or check.columns), check.keys[0], check.tag + suffix
    head = f"'{check.layer}' as layer, '{check.table}' as \"table\", '{validation}' as validation"
    key = {"s": f"'{pk}=' || s.{pk}", "t": f"'{pk}=' || t.{pk}"}
    src, tgt = f"{st}({sdb})", f"{tt}({tdb})"
    whole = {a: _row_text(f"{a}.", [pk, *columns]) for a in "st"}
    parts = []
    for i, c in enumerate(columns):
        parts.append(
            f"select {q} as q, 0 as k, s.{pk}::varchar as kt, {i} as p, {head}, 'Column Value Mismatch' as type, "
            f"'High' as severity, '{c} value differs at [' || {key['s']} || ']' as title, "
            f"'{c} must be identical in source and target.' as expected, "
            f"'[' || {key['s']} || '] Column ''{c}'' -> Source {src} = ''' || coalesce(s.{c}::varchar, 'None') || "
            f"'''  |  Target {tgt} = ''' || coalesce(t.{c}::varchar, 'None') || '''' as actual, "
            f"'The ''{c}'' value was not carried correctly from {st} to {tt} (it changed during the movement).' "
            f"as root_cause, 'Fix the load logic so ''{c}'' is preserved, or correct the source data; then reload "
            f"{tt}.' as fix from {tag} where in_s and in_t and d{i}"
        )
    if not tolerated:
        parts.append(
            f"select {q}, 1, s.{pk}::varchar, 0, {head}, 'Missing Record in Target', 'High', "
            f"'Record [' || {key['s']} || '] is in source but MISSING in target ({tt})', "
            f"'Every record in {st} must also exist in {tt}.', "
            f"'Present in {src} but NOT found in {tgt}.' || chr(10) || 'Source row: ' || {whole['s']}, "
            f"'Record [' || {key['s']} || '] exists in {st} but was not loaded into {tt} - the row was dropped or "
            "rejected during the movement (check load filters / rejection logic).', "
            f"'Investigate why the record was not loaded and reload {tt}.' from {tag} where in_s and not in_t"
        )
    parts.append(
        f"select {q}, 2, t.{pk}::varchar, 0, {head}, 'Missing Record in Source (extra in target)', 'Medium', "
        f"'Record [' || {key['t']} || '] is in target ({tt}) but MISSING in source', "
        f"'{tt} must not contain records absent from {st}.', "
        f"'Present in {tgt} but NOT found in {src}.' || chr(10) || 'Target row: ' || {whole['t']}, "
        f"'Record [' || {key['t']} || '] exists in {tt} but not in {st} - an orphan/unexpected insert, or the "
        f"source row was deleted after the target was loaded.', 'Verify the source; remove the orphan {tt} row or "
        f"restore the source record, then reconcile.' from {tag} where in_t and not in_s"
    )
    for p, (side, alias, name) in enumerate((("source", "s", st), ("target", "t", tt))):
        parts.append(
            f"select {q}, 3, {alias}.{pk}::varchar, {p}, {head}, 'Duplicate Record', 'High', "
            f"'Duplicate business key [' || {key[alias]} || '] on the {side} side', "
            "'Each business key must appear at most once.', "
            f"'Duplicate in {name} ({side} side): key [' || {key[alias]} || '] appears ' || n_{alias} || ' times. "
            f"Example row: ' || {whole[alias]}, "
            f"'Business key [''{pk}''] appears more than once in {name} (missing de-duplication or unique key).', "
            f"'Add/enforce a unique constraint or a de-duplication step.' from {tag} where n_{alias} > 1"
        )
    return parts


def _findings() -> str:
    integrity = "data_integrity_Validation"
    parts = [
        *_compared_rows(11, O1, "direct_move_Validation", "orders", "ps_orders", "Sales_Source", "Sales_PreStaging"),
        *_compared_rows(17, O2, integrity, "ps_orders", "stg_orders", "Sales_PreStaging", "Sales_Staging", tolerated=True),
        *_compared_rows(24, C3, integrity, "stg_customer", "dim_customer", "Sales_Staging", "Sales_DWH"),
        *_compared_rows(30, O3, integrity, "stg_orders", "fact_orders", "Sales_Staging", "Sales_DWH"),
        *_compared_rows(
            32, O3, "ColumnValues_Check", "stg_orders", "fact_orders", "Sales_Staging", "Sales_DWH", "_values", FACT_VALUES
        ),
    ]
    generic = _quote(fixed.FIX_GENERIC)
    other = f"'{L1}', 'Orders'"

    def single(
        seq: int, v: str, kind: str, severity: str, expected: str, actual: str, cause: str, source: str, at: str = other
    ) -> str:
        return (
            f"select {seq}, 0, '', 0, {at}, '{v}', '{kind}', '{severity}', '{v} failed', '{expected}', {actual}, "
            f"{cause}, '{generic}' from ({source})"
        )

    counts = "select (select count(*) from orders) as s, (select count(*) from ps_orders) as t"
    parts.append(
        single(
            7, "Count_Validation", "Row Count Mismatch", "High", "Source and target row counts match for the movement.",
            "'Source rows = ' || s || '  |  Target rows = ' || t || '  (diff = ' || (s - t) || ')'",
            "'Source and target counts differ by ' || (s - t) || ' (' || case when s > t then 'rows lost' else "
            "'extra rows' end || ' in the movement).'",
            f"select * from ({counts}) where s <> t",
        )
    )
    current = (
        "select (select count(*) from stg_customer where \"IsValid\" = 1) as s, "
        "(select count(*) from dim_customer where \"IsCurrent\" = 1) as t"
    )
    parts.append(
        single(
            20, "Count_Validation", "Row Count Mismatch", "High", "Source and target row counts match for the movement.",
            "'Source rows = ' || s || '  |  Target rows = ' || t || '  (diff = ' || (s - t) || ')'",
            "'Source and target counts differ by ' || (s - t) || ' (' || case when s > t then 'rows lost' else "
            "'extra rows' end || ' in the movement).'",
            f"select * from ({current}) where s <> t", f"'{L3}', 'Customers'",
        )
    )
    parts.append(
        single(
            31, "ForeignKey_Check", "Foreign Key Violation", "High",
            "Every fact surrogate key exists in its dimension and required keys are populated.", "message",
            "'A fact surrogate key has no matching dimension row (orphan) or a required key column is NULL.'",
            f"select * from ({FACT_KEY}) where status = 'FAIL'", f"'{L3}', 'Orders'",
        )
    )
    groups = "select o_orderkey, count(*) as n from ps_orders group by o_orderkey having count(*) > 1"
    parts.append(
        f"select 8, 0, o_orderkey::varchar, 0, {other}, 'Duplicate_Validation', 'Duplicate Business Key', 'Medium', "
        "'Duplicate_Validation failed', 'No duplicate business keys in the target.', "
        "'Duplicate key(s) in target: ' || o_orderkey || ' (x' || n || ')', "
        f"'Business key [''o_orderkey''] is duplicated in the target.', '{generic}' from ({groups})"
    )
    parts.append(
        single(
            9, "Null_Validation", "NULL in Required Column", "High", "Required columns contain no NULLs.",
            "'NULLs in target required column(s): o_custkey = ' || n || ' NULL(s)'",
            "'Required (NOT NULL) column(s) contain NULLs in the target.'",
            "select count(*) as n from ps_orders where o_custkey is null",
        )
    )
    parts.append(
        single(
            10, "Constraint_Validation", "Constraint Violation", "High", "Key columns are unique and not null.",
            "n || ' duplicate key group(s)'", "'Key column(s) are not unique / not populated in the target.'",
            f"select count(*) as n from ({groups})",
        )
    )
    every = "\nunion all ".join(parts)
    first = 'row_number() over (partition by layer, "table", type, actual order by q, k, kt, p) = 1'
    return f"select * from ({every}) qualify {first}"


FINDING_COLUMNS = 'layer, "table", validation, type, severity, title, expected, actual, root_cause, fix'
_FINDING_CTES = [*FULL_RUN, f"f as ({_findings()})"]

_TEST_NAMES = " ".join(f"when '{v}' then '{e[2]}'" for v, e in fixed.CHECK_EXPECTATIONS.items())
TICKETS = f"""
select 'DEF_' || case when n < 1000 then lpad(n::varchar, 3, '0') else n::varchar end as defectid,
       type as defect_type, severity, layer, "table", layer || ' / ' || "table" || ': ' || title as title,
       '1. Ensure the data is loaded/seeded for this scenario.' || chr(10) || '2. Run `' || validation || '` for ' ||
       "table" || ' in ' || layer || ' (test `' || case validation {_TEST_NAMES} end || '`).' || chr(10) ||
       '3. Observe: ' || type || '.' as steps_to_reproduce,
       expected as expected_result, actual as actual_result, root_cause as probable_root_cause,
       fix as suggested_fix, 'New' as status
from (select *, row_number() over (order by q, k, kt, p) as n from f)"""

# ---- catalogue ---------------------------------------------------------------------------------------------------

_TYPES = {
    "o_orderkey": ("bigint", "19"), "o_custkey": ("bigint", "19"), "o_orderstatus": ("string", None),
    "o_totalprice": ("double", "53"), "o_orderdate": ("timestamp_ntz", ""), "o_orderpriority": ("string", None),
    "c_custkey": ("bigint", "19"), "c_name": ("string", None), "c_nationkey": ("int", "10"),
    "c_acctbal": ("double", "53"), "c_mktsegment": ("string", None), "CustomerSK": ("bigint", "19"),
    "IsCurrent": ("int", "10"), "IsValid": ("int", "10"), "RejectionReason": ("string", None),
}
_ORDERS = ["o_orderkey", *ORDER_VALUES]
_CUSTOMER = ["c_custkey", *CUSTOMER_VALUES]


def _profile(table: str, columns: Sequence[str]) -> str:
    parts = []
    for i, c in enumerate(columns, start=1):
        dtype, size = _TYPES[c]
        observed = f"coalesce(max(length(\"{c}\")), 0)::varchar" if size is None else f"'{size}'"
        parts.append(
            f"select '{c}' as name, {i} as ordinal, '{dtype}' as data_type, {observed} as size, "
            f"case when count(*) filter (\"{c}\" is null) > 0 then 'YES' else 'NO' end as nullable, "
            f"count(*) filter (\"{c}\" is null) as null_count from {table}"
        )
    return " union all ".join(parts)


def _mapping(source: str, target: str, source_db: str, target_db: str, source_columns: Sequence[str],
             target_columns: Sequence[str], labels: dict[str, tuple[str, str]], rule: str) -> str:
    """``labels``: column -> (source constraints, target constraints)."""
    values = ", ".join(f"('{c}', '{s}', '{t}')" for c, (s, t) in labels.items())
    return f"""
select case when s.name is null then '' else '{source_db}' end as "Source DB Name",
       case when s.name is null then '' else '{source}' end as "Source Table Name",
       coalesce(s.name, '') as "Source Column Name", coalesce(s.data_type, '') as "Source Data Type",
       coalesce(s.size, '') as "Source Size", coalesce(s.nullable, '') as "Source Nullability",
       case when s.name is null then '' else coalesce(c.sc, '') end as "Source Constraints",
       {rule} as "Transformation Rule", '{target_db}' as "Target DB Name", '{target}' as "Target Table Name",
       t.name as "Target Column Name", t.data_type as "Target Data Type", t.size as "Target Size",
       t.nullable as "Target Nullability", coalesce(c.tc, '') as "Target Constraints"
from ({_profile(target, target_columns)}) t
left join ({_profile(source, source_columns)}) s on lower(s.name) = lower(t.name)
left join (values {values}) as c(name, sc, tc) on c.name = t.name"""


def _mapping_doc() -> str:
    d = fixed.RULE_DIMENSION
    direct = f"'{fixed.RULE_DIRECT}'"

    def warehouse(dim: str) -> str:
        loaded = _quote(d[dim])
        return (
            f"case when lower(t.name) like '%sk' then '{fixed.RULE_SURROGATE_KEY}' "
            f"when lower(t.name) = 'iscurrent' then '{fixed.RULE_SCD}' "
            f"when s.name is not null then '{loaded}' else '{loaded}{fixed.RULE_DERIVED_SUFFIX}' end"
        )

    key = "Business Key, NOT NULL"
    return "\nunion all ".join(
        [
            _mapping("customer", "ps_customer", "Sales_Source", "Sales_PreStaging", _CUSTOMER, _CUSTOMER,
                     {"c_custkey": (key, key), "c_name": ("NOT NULL", "NOT NULL")}, direct),
            _mapping("orders", "ps_orders", "Sales_Source", "Sales_PreStaging", _ORDERS, _ORDERS,
                     {"o_orderkey": ("PK, NOT NULL", key),
                      "o_custkey": ("FK -> customer, NOT NULL", "FK -> ps_customer, NOT NULL")}, direct),
            _mapping("ps_orders", "stg_orders", "Sales_PreStaging", "Sales_Staging", _ORDERS,
                     [*_ORDERS, "IsValid", "RejectionReason"],
                     {"o_orderkey": (key, key), "o_custkey": ("FK -> ps_customer, NOT NULL", "NOT NULL")},
                     "case t.name when 'o_orderstatus' then 'Status must be a known upper-case value' "
                     "when 'o_orderpriority' then 'Priority must be trimmed; Priority must start with its number' "
                     "when 'o_totalprice' then 'Price must be at least 2000' "
                     "when 'IsValid' then 'Validity flag set by load proc: 1 = accepted, 0 = rejected' "
                     "when 'RejectionReason' then 'Reason text populated when the row is rejected (IsValid = 0)' "
                     "else 'Cleaned & standardised (trim spaces, standardise case), then copied' end"),
            _mapping("stg_customer", "dim_customer", "Sales_Staging", "Sales_DWH", [*_CUSTOMER, "IsValid"],
                     ["CustomerSK", *_CUSTOMER, "IsCurrent"],
                     {"CustomerSK": ("", "PK"), "c_custkey": (key, "UNIQUE, " + key), "c_name": ("NOT NULL", "NOT NULL")},
                     warehouse("Type2")),
            _mapping("stg_orders", "fact_orders", "Sales_Staging", "Sales_DWH", _ORDERS,
                     ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "CustomerSK"],
                     {"o_orderkey": (key, key)}, warehouse("Fact")),
        ]
    )


_TABLES = {
    (L1, "Customers"): ("customer", "ps_customer"), (L1, "Orders"): ("orders", "ps_orders"),
    (L2, "Orders"): ("ps_orders", "stg_orders"), (L3, "Customers"): ("stg_customer", "dim_customer"),
    (L3, "Orders"): ("stg_orders", "fact_orders"),
}
_RULE_TEXTS = (
    "o_orderstatus (Status must be a known upper-case value); o_orderpriority (Priority must be trimmed); "
    "o_orderpriority (Priority must start with its number); o_totalprice (Price must be at least 2000)"
)


def _catalogue() -> str:
    values = []
    counters: dict[tuple[str, str], int] = {}
    lists = {
        "Customers": ("c_custkey", "c_custkey, c_name", ", ".join(CUSTOMER_VALUES)),
        "Orders": ("o_orderkey", "o_orderkey, o_custkey", ", ".join(ORDER_VALUES)),
    }
    for layer, table, v in RUN_NAMES:
        if v not in fixed.CATALOGUE_TEXTS:
            continue
        number = counters[layer, table] = counters.get((layer, table), 0) + 1
        kind, columns, _, _, _, priority = fixed.CATALOGUE_TEXTS[v]
        keys, required, compare = lists[table]
        if (layer, table) == (L3, "Orders"):
            required, compare = "o_orderkey", "o_orderstatus, o_totalprice, o_orderdate"
        shown = {
            "keys": keys, "not_null": required, "compare": compare,
            "rules": "o_orderstatus, o_orderpriority, o_orderpriority, o_totalprice",
        }[columns]
        tags = [fixed.LAYER_TAGS[layer], table.lower(), *fixed.CHECK_TAGS[v]]
        tags += ["fact"] if (layer, table) == (L3, "Orders") else []
        case_id = f"TC_{fixed.LAYER_CODES[layer]}_{table[:3].upper()}_{number:03d}"
        _, _, description, steps, expected, _ = fixed.CATALOGUE_TEXTS[v]
        source, target = _TABLES[layer, table]
        filled = {"source": source, "target": target, "keys": keys, "not_null": required, "rules": _RULE_TEXTS}
        texts = [t.format(**filled) for t in (description, fixed.PRECONDITION, steps, expected)]
        row = [case_id, layer, table, v, shown, kind, priority, ",".join(tags), *map(_quote, texts)]
        values.append("(" + ", ".join(f"'{x}'" for x in row) + ")")
    return (
        "select c.id as test_case_id, c.layer, c.tbl as table_name, c.cols as columns, c.kind as test_type, "
        "c.priority, c.tags, c.description, c.precondition, c.steps, c.expected, r.status "
        f"from (values {', '.join(values)}) as c(id, layer, tbl, validation, cols, kind, priority, tags, "
        "description, precondition, steps, expected) "
        f"left join ({_run(_EVERY)}) r on r.layer = c.layer and r.\"table\" = c.tbl and r.validation = c.validation"
    )


# ---- loads -------------------------------------------------------------------------------------------------------

CUSTOMER_VERSIONS = """
later as (
  select c_custkey, c_name, c_nationkey,
         case when c_custkey % 7 = 0 then c_acctbal + 10.0::double else c_acctbal end as c_acctbal,
         case when c_custkey % 5 = 0 then 'NEW ' || c_mktsegment else c_mktsegment end as c_mktsegment
  from customer where c_custkey % 9 <> 0
  union all
  select c_custkey + 10000000, c_name, c_nationkey, c_acctbal, c_mktsegment from customer where c_custkey % 4 = 0),
first_load as (select row_number() over (order by c_custkey) as sk, * from customer)"""

LOAD_SCD1 = """
select f.sk as "CustomerSK", f.c_custkey, coalesce(l.c_name, f.c_name) as c_name,
       coalesce(l.c_nationkey, f.c_nationkey) as c_nationkey, coalesce(l.c_acctbal, f.c_acctbal) as c_acctbal,
       coalesce(l.c_mktsegment, f.c_mktsegment) as c_mktsegment
from first_load f left join later l using (c_custkey)
union all
select (select max(sk) from first_load) + row_number() over (order by c_custkey), *
from later l where not exists (select 1 from first_load f where f.c_custkey = l.c_custkey)"""

LOAD_SCD2 = """
select f.sk as "CustomerSK", f.c_custkey, f.c_name, f.c_nationkey, f.c_acctbal, f.c_mktsegment,
       case when c.c_custkey is null then 1 else 0 end as "IsCurrent", timestamp '2024-01-01' as "EffectiveDate",
       case when c.c_custkey is null then null else timestamp '2024-02-01' end as "ExpiryDate"
from first_load f left join changed c on c.c_custkey = f.c_custkey
union all
select (select max(sk) from first_load) + row_number() over (order by c_custkey), *, 1, timestamp '2024-02-01', null
from (select * from changed union all
      select * from later l where not exists (select 1 from first_load f where f.c_custkey = l.c_custkey))"""

CHANGED = """
changed as (
  select l.* from later l join first_load f using (c_custkey)
  where l.c_acctbal <> f.c_acctbal or l.c_mktsegment <> f.c_mktsegment)"""

LOAD_FACT = """
select l_linenumber, l_quantity, l_extendedprice, o.o_orderkey + 1000 as "OrderSK", s.s_suppkey + 5 as "SupplierSK",
       d."CustomerSK"
from lineitem l
left join orders o on o.o_orderkey = l.l_orderkey
left join (select * from supplier where s_suppkey % 10 <> 3) s on s.s_suppkey = l.l_suppkey
left join (select * from dim_customer where "IsCurrent" = 1) d on d.c_custkey = o.o_custkey"""

INJECT_DEFECTS = """
select c_custkey,
       case when c_custkey % 25 = 2 then lower(c_name)
            when c_custkey % 20 = 1 then '  ' || c_name || '  ' else c_name end as c_name,
       c_nationkey,
       case when c_custkey % 30 = 3 then -abs(c_acctbal) else c_acctbal end as c_acctbal,
       case when c_custkey % 20 = 2 then 'X' else c_mktsegment end as c_mktsegment,
       nullif(case when c_custkey % 20 in (1, 2) or c_custkey % 30 = 3 then 'NEGATIVE: ' else '' end ||
              concat_ws('; ', case when c_custkey % 20 = 1 then 'name has spaces' end,
                        case when c_custkey % 20 = 2 then 'segment is unknown' end,
                        case when c_custkey % 30 = 3 then 'balance is negative' end,
                        case when c_custkey % 25 = 2 then 'lower-case name' end), '') as _note
from customer"""

_EXACT = (
    "picked as (select *, row_number() over (order by substr(md5(c_custkey::varchar || '|7'), 1, 15), c_custkey) as r from customer)"
)
INJECT_EXACT = """
select c_custkey, case when r <= 2 then '  ' || c_name || '  ' else c_name end as c_name,
       case when r = 3 then 'not-an-address' else 'c' || c_custkey || '@example.com' end as email,
       case when r in (7, 8) then substr(lpad(c_nationkey::varchar, 3, '0'), 1, 2) else lpad(c_nationkey::varchar, 3, '0') end as code,
       case when r in (5, 6) then -abs(c_acctbal) - 1 else c_acctbal end as c_acctbal,
       case when r = 4 then 'X' when r between 9 and 25 then lower(c_mktsegment) else c_mktsegment end as c_mktsegment,
       case when r <= 2 then 'NEGATIVE: name has spaces' when r = 3 then 'NEGATIVE: address is not valid'
            when r = 4 then 'NEGATIVE: segment is unknown' when r <= 6 then 'NEGATIVE: balance is negative'
            when r <= 8 then 'NEGATIVE: code has not three digits' when r <= 25 then 'lower-case segment' end as _note
from picked"""


def _rows_read(layer: str, table: str, check: str) -> str:
    """Rows that a check takes from its tables: both sides for counts and comparisons, the target for all others."""
    names = {
        (L1, "Customers"): ("customer", "ps_customer"), (L1, "Orders"): ("orders", "ps_orders"), (L2, "Orders"): ("ps_orders", "stg_orders"),
        (L3, "Customers"): ("stg_customer", "dim_customer"), (L3, "Orders"): ("stg_orders", "fact_orders"),
    }
    source, target = names[layer, table]
    source = f"{source} where \"IsValid\" = 1" if layer == L3 else source
    everything = target
    if (layer, table) == (L3, "Customers"):
        target = everything = f'{target} where "IsCurrent" = 1'
    if layer == L2:
        target = f'{target} where "IsValid" = 1'
    read = {
        "Metadata_Validation": [], "Count_Validation": [source, everything], "Duplicate_Validation": [target], "Null_Validation": [target],
        "Constraint_Validation": [target, target], "Transformation_Validation": [target], "ForeignKey_Check": [target, "dim_customer"],
    }.get(check, [source, target])
    counts = " + ".join(f"(select count(*) from {rows})" for rows in read) or "0"
    return f"select '{layer}' as layer, '{table}' as \"table\", '{check}' as validation, ({counts})::bigint as rows_read"


# ---- all ---------------------------------------------------------------------------------------------------------

KNOWN = "known_customer as (select c_custkey from customer where c_custkey % 50 <> 0)"
KNOWN_NULL = "known_customer as (select case when c_custkey % 50 = 0 then null else c_custkey end as c_custkey from customer)"
SHIPPED = (
    "items as (select l_orderkey, l_linenumber, l_partkey, l_quantity, l_shipdate from lineitem), "
    "shipped as (select * from items where l_shipdate >= timestamp '1997-01-01')"
)


def _drop_seq(sql: str) -> str:
    return f'select layer, "table", validation, category, status, message from ({sql})'


def _both(*rows: str) -> str:
    return _drop_seq(" union all ".join(f"({r})" for r in rows))


def _rule_rows(column: str, condition: str) -> str:
    return with_([PS_ORDERS], f"select o_orderkey, {column} from ps_orders where {condition}")


# ---- full reload -------------------------------------------------------------------------------------------------

RELOAD = [
    PS_ORDERS,
    STG_ORDERS,
    """r_customer as (
      select c_custkey, upper(trim(c_name)) as c_name, c_nationkey, c_acctbal, upper(trim(c_mktsegment)) as c_mktsegment,
             c_acctbal < 0 as bad from customer)""",
    """r_item as (
      select *, concat_ws('; ', case when l_quantity < 5 then 'Quantity must be at least 5' end,
             case when row_number() over (
               partition by l_orderkey, l_linenumber order by l_quantity < 5, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) > 1
               then 'Duplicate business key' end) as reason
      from lineitem)""",
    """r_dim_customer as (
      select *, row_number() over (order by c_custkey) as sk from r_customer where not bad)""",
    "r_dim_supplier as (select *, row_number() over (order by s_suppkey) as sk from supplier)",
    """r_dim_orders as (
      select *, row_number() over (order by o_orderkey) as sk from stg_orders where "IsValid" = 1)""",
    """r_fact as (
      select o.sk as osk, s.sk as ssk, c.sk as csk, l_linenumber, l_extendedprice
      from (select * from r_item where reason = '') l left join r_dim_orders o on l_orderkey = o_orderkey
      left join r_dim_supplier s on l_suppkey = s_suppkey left join r_dim_customer c on o_custkey = c_custkey)""",
]
RELOADED = """
    select 'ps_supplier' as table_name, s_suppkey::bigint as k1, s_nationkey::bigint as k2, null::bigint as k3, null::bigint as k4,
           s_acctbal::double as amount, s_name as note from supplier
    union all select 'ps_lineitem', l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice, null from lineitem
    union all select 'stg_orders', o_orderkey, o_custkey, null, null, o_totalprice, concat_ws('|', "IsValid", "RejectionReason") from stg_orders
    union all select 'stg_customer', c_custkey, c_nationkey, null, null, c_acctbal,
           case when bad then '0|Balance must not be negative' else '1' end from r_customer
    union all select 'stg_lineitem', l_orderkey, l_linenumber, l_suppkey, null, l_extendedprice,
           case when reason = '' then '1' else '0|' || reason end from r_item
    union all select 'dim_customer', sk, c_custkey, c_nationkey, 1, c_acctbal, c_name || '|' || c_mktsegment from r_dim_customer
    union all select 'dim_supplier', sk, s_suppkey, s_nationkey, null, s_acctbal, upper(trim(s_name)) from r_dim_supplier
    union all select 'dim_orders', sk, o_orderkey, o_custkey, null, o_totalprice, o_orderstatus || '|' || o_orderpriority from r_dim_orders
    union all select 'fact_lineitem', osk, ssk, csk, l_linenumber, l_extendedprice, null from r_fact
"""
_STAGES = [
    (0, "prestaging", "ps_lineitem", "lineitem"), (0, "prestaging", "ps_customer", "customer"),
    (0, "prestaging", "ps_supplier", "supplier"), (0, "prestaging", "ps_orders", "ps_orders"),
    (1, "staging", "stg_lineitem", "lineitem"), (1, "staging", "stg_customer", "customer"),
    (1, "staging", "stg_supplier", "supplier"), (1, "staging", "stg_orders", "ps_orders"),
    (2, "dwh", "dim_customer", "r_dim_customer"), (2, "dwh", "dim_supplier", "supplier"), (2, "dwh", "dim_orders", "r_dim_orders"),
    (3, "dwh", "fact_lineitem", "r_fact"),
]


def oracle_sql() -> dict[str, str]:
    stg = [PS_ORDERS, STG_ORDERS]
    c3 = [STG_CUSTOMER, DIM_CUSTOMER]
    metadata_missing = O1.metadata().replace("when true", "when false").replace(
        "'all 6 expected columns present on both sides'",
        "'missing in source=[], missing in target=[''o_orderpriority'']'",
    )
    totals = with_(
        FULL_RUN,
        "select count(*) as total, count(*) filter (status = 'PASS') as passed, "
        "count(*) filter (status in ('FAIL', 'ERROR')) as failed, count(*) filter (status = 'ERROR') as errors, "
        "count(*) filter (status = 'SKIP') as skipped from (select status from ("
        # the column check of the customers fails; their null check and comparison cannot be planned
        + _run([(i, RUN[i]) for i, at in enumerate(RUN_NAMES) if at[:2] != (L1, "Customers") or at[2] in _PLANNED])
        + ") union all values ('FAIL'), ('ERROR'), ('ERROR'))",
    )
    return {
        "scan_filtered": "select o_orderkey, o_custkey, o_totalprice from orders "
        "where o_orderstatus = 'F' and o_totalprice > 400000",
        "scan_sql": "select o_orderstatus, count(*) as n_orders, max(o_totalprice) as max_price "
        "from orders join customer on o_custkey = c_custkey where c_acctbal > 0 group by o_orderstatus",
        "filtered_count": with_([PS_ORDERS], "select count(*) as cnt from ps_orders where o_custkey is null"),
        "column_metadata": with_([PS_ORDERS], _profile("ps_orders", _ORDERS)),
        "snapshot_roundtrip": "select 'sales.customer' as table_name, c_custkey as row_key, c_acctbal as amount from customer "
        "union all select 'sales.orders', o_orderkey, o_totalprice from orders "
        "union all select 'old.orders', o_orderkey, o_totalprice from orders where o_orderstatus = 'F'",
        "column_list": "select * from (values "
        + ", ".join(f"('{c}', {i})" for i, c in enumerate(["o_orderkey", *ORDER_VALUES], start=1))
        + ") as c(name, ordinal)",
        "comparison_screened": "select sum((d <> e)::int)::bigint as diffs, 0::bigint as missing_in_target, "
        "0::bigint as missing_in_source, bool_and(d = e) as is_match from (select "
        "1000000000000000000.01::decimal(38,2) + o_orderkey as d, 1000000000000000000.01::decimal(38,2) + o_orderkey + "
        "(case when o_orderkey % 5 = 0 then 0.01 else 0 end)::decimal(38,2) as e from orders)",
        **{
            f"rule_{name}_double": "select o_orderkey, o_totalprice * 1000 as price from orders "
            f"where {condition}"
            for name, condition in (
                ("length_equals", "length(replace((o_totalprice * 1000)::varchar, 'e+', 'e')) <> 10"),
                ("in_set", "(o_totalprice * 1000)::varchar not in ('10000000.0', '20000000.0')"),
                ("regex", "not regexp_matches((o_totalprice * 1000)::varchar, '^[12][0-9.]*$')"),
            )
        },
        "failed_results": with_(FULL_RUN, f"select seq, layer, \"table\", validation, status from ({_run(_EVERY)}) where status = 'FAIL'"),
        "executed_results": with_(
            [*ALL_LAYERS, *COMPARISONS[4:]],
            "select seq, layer, \"table\", validation, status from "
            f"({_chosen(_COUNT_OR_FACT, 'count_check or fact')}) where status <> 'SKIP'",
        ),
        "skipped_results": "select seq, layer, \"table\", validation, status from "
        f"({_skipped([i for i in range(len(RUN)) if i not in _COUNT_OR_FACT], 'x')})",
        "run_with_broken_checks": with_(
            [PS_ORDERS, O1.cte(False)],
            "select layer, \"table\", validation, status from ("
            + _run(list(enumerate([*O1.base(), O1.exact("direct_move_Validation")])))
            + f") union all values ('{L1}', 'Orders', 'Transformation_Validation', 'ERROR'), "
            + ", ".join(f"('{L1}', 'Absent', '{v}', 'ERROR')" for v in ("Metadata_Validation", "Count_Validation", "direct_move_Validation"))
            # the target of the absent table is there, so that checks of the target alone go on
            + " union all select layer, 'Absent', validation, status from ("
            + _run(list(enumerate(O1.base())))
            + ") where validation in ('Duplicate_Validation', 'Null_Validation', 'Constraint_Validation')"
            + f" union all values ('{L1}', 'Absent', 'Transformation_Validation', 'PASS')",
        ),
        "negative_rows": "select count(*) filter (c_custkey % 20 in (1, 2) or c_custkey % 30 = 3) as negative_rows from customer",
        "normalise_values": with_(
            [PS_ORDERS],
            "select o_orderkey, o_custkey::double as o_custkey, nullif(trim(o_orderstatus), '') as o_orderstatus, "
            "o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as o_orderdate, "
            "nullif(trim(o_orderpriority), '') as o_orderpriority from ps_orders",
        ),
        "compare_keys": with_(
            ORDERS_SENSITIVE,
            "select coalesce(s.o_orderkey, t.o_orderkey) as o_orderkey, n_s as n_source, n_t as n_target, "
            "case when not in_t then 'source_only' when not in_s then 'target_only' else 'both' end as state from c",
        ),
        "cell_diffs": with_(ORDERS_SENSITIVE, _cell_diffs()),
        "diff_pairs": with_(
            ORDERS_INSENSITIVE,
            "select concat_ws(',', "
            + ", ".join(f"case when d{i} then '{c}' end" for i, c in enumerate(ORDER_VALUES))
            + ") as diff_columns, "
            + ", ".join(f"{a}.{c} as {n}_{c}" for a, n in (("s", "source"), ("t", "target")) for c in _ORDERS)
            + " from c where in_s and in_t and ("
            + " or ".join(f"d{i}" for i in range(len(ORDER_VALUES)))
            + ")",
        ),
        "missing_in_target": with_(
            ORDERS_SENSITIVE, f"select {', '.join(f's.{c} as {c}' for c in _ORDERS)} from c where in_s and not in_t"
        ),
        "missing_in_source": with_(
            ORDERS_SENSITIVE, f"select {', '.join(f't.{c} as {c}' for c in _ORDERS)} from c where in_t and not in_s"
        ),
        "duplicate_rows": with_(
            [SHIPPED],
            " union all ".join(
                f"select * from (select *, count(*) over (partition by l_orderkey, l_linenumber) as _copies, "
                f"'{side}' as _side from {rows}) where _copies > 1"
                for side, rows in (("source", "items"), ("target", "shipped"))
            ),
        ),
        "comparison_summary": with_(
            ORDERS_SENSITIVE,
            "select *, diffs + missing_in_target + missing_in_source + duplicates = 0 as is_match from "
            f"({_counts('c', len(ORDER_VALUES))})",
        ),
        "count_check": with_([*stg, *c3], _both(O2.count(), C3.count())),
        "duplicate_check": with_([PS_ORDERS], _both(ITEMS.duplicate(), O1.duplicate())),
        "duplicate_messages": with_(
            [PS_ORDERS],
            " union all ".join(
                _duplicate_message(*table)
                for table in (
                    ("lineitem", "lineitem", ["l_orderkey", "l_linenumber"]),
                    ("ps_orders", "ps_orders", ["o_orderkey"]),
                    (
                        "segments",
                        "(select case when c_nationkey <> 3 then c_nationkey end as nation, c_mktsegment as segment from customer)",
                        ["nation", "segment"],
                    ),
                    ("customer", "customer", ["c_custkey"]),
                )
            ),
        ),
        "null_check": with_([PS_ORDERS], _drop_seq(O1.null())),
        "metadata_check": with_([PS_ORDERS], _both(metadata_missing, O1.count())),
        "constraint_check": with_(c3, _both(ITEMS.constraint(), C3.constraint())),
        "direct_move_check": with_(
            [PS_ORDERS, PS_CUSTOMER, O1.cte(False), C1.cte(False)],
            _both(O1.exact("direct_move_Validation"), C1.exact("direct_move_Validation")),
        ),
        "integrity_check": with_([*stg, *c3, O2.cte(True), C3.cte(True)], _both(O2.integrity(True), C3.integrity())),
        "transformation_check": with_(stg, _both(RAW.transformation(), O2.transformation())),
        "fk_check": with_(
            [PS_ORDERS, KNOWN], _drop_seq(_foreign_key(L1, "o_custkey", "ps_orders", "known_customer", "c_custkey"))
        ),
        "fk_check_null_aware": with_(
            [PS_ORDERS, KNOWN_NULL],
            _drop_seq(_foreign_key(L1, "o_custkey", "ps_orders", "known_customer", "c_custkey", True)),
        ),
        "fk_orphans": with_(
            [PS_ORDERS, KNOWN],
            "select o_custkey, count(*) as n_rows from ps_orders p where o_custkey is not null and not exists "
            "(select 1 from known_customer k where k.c_custkey = p.o_custkey) group by o_custkey",
        ),
        "column_values_check": with_(
            [*stg, DIM_CUSTOMER, FACT_ORDERS, O3.cte(True, FACT_VALUES, "_values")],
            _drop_seq(O3.exact("ColumnValues_Check", "value_check", "_values", FACT_VALUES)),
        ),
        "basic_checks": with_([PS_ORDERS], _both(*O1.base())),
        "rule_not_null": _rule_rows("o_custkey", "o_custkey is null"),
        "rule_no_whitespace": _rule_rows("o_orderpriority", "o_orderpriority <> trim(o_orderpriority)"),
        "rule_length_equals": _rule_rows("o_orderpriority", "length(o_orderpriority) <> 5"),
        "rule_in_set": _rule_rows("o_orderstatus", "o_orderstatus not in ('F', 'O', 'P')"),
        "rule_regex": _rule_rows("o_orderpriority", "not regexp_matches(o_orderpriority, '^[1-5]-')"),
        "rule_min_value": "select c_custkey, c_acctbal from customer where c_acctbal < 0",
        "results_ordered": with_(FULL_RUN, _run(_EVERY)),
        "select_checks": with_(
            [*ALL_LAYERS, *COMPARISONS[4:]], _chosen(_COUNT_OR_FACT, "count_check or fact")
        ),
        "gated_run": with_(
            [PS_ORDERS],
            "select -1 as seq, 'Prerequisite' as layer, 'ALL' as \"table\", 'Reset_And_Reload' as validation, "
            f"'prerequisite' as category, status, message from ({O1.count()}) union all "
            f"({_skipped(range(len(RUN)), fixed.SKIPPED_BY_GATE)})",
        ),
        "summary_counts": with_(FULL_RUN, _summary(_run(_EVERY))),
        "summary_by_layer": with_(
            FULL_RUN,
            "select layer, count(*) filter (status = 'PASS') as passed, count(*) filter (status = 'FAIL') as failed, "
            f"count(*) filter (status = 'SKIP') as skipped from ({_run(_EVERY)}) group by layer",
        ),
        "run_totals": totals,
        "failure_records": with_(
            [*ALL_LAYERS, O1.cte(False), O2.cte(True), O3.cte(True), O3.cte(True, FACT_VALUES, "_values")], FAILURE_RECORDS
        ),
        "detail_records_by_table": with_([*ALL_LAYERS, *COMPARISONS], _detail_records(40)),
        "findings": with_(_FINDING_CTES, f"select {FINDING_COLUMNS} from f"),
        "tickets": with_(_FINDING_CTES, TICKETS),
        "mapping_doc": with_(ALL_LAYERS, _mapping_doc()),
        "constraint_labels": with_(
            [PS_ORDERS],
            "select name, case name when 'o_orderkey' then 'Business Key, NOT NULL' "
            "when 'o_custkey' then 'FK -> ps_customer, NOT NULL' else '' end as constraints, null_count "
            f"from ({_profile('ps_orders', _ORDERS)})",
        ),
        "check_catalogue": with_(FULL_RUN, _catalogue()),
        "reload_all_layers": with_(RELOAD, RELOADED),
        "reload_journal": with_(
            RELOAD,
            " union all ".join(
                f"select {level} as level, '{db}' as database, '{name}' as \"table\", (select count(*) from {rows}) as row_count"
                for level, db, name, rows in _STAGES
            ),
        ),
        "case_folding": "select c_custkey, 'name' as \"column\", case c_custkey % 6 when 3 then 'Fine ' else 'I\u0131 ' end || c_name as source_value, "
        "case c_custkey % 6 when 3 then 'fyne ' else 'II ' end || c_name as target_value, way "
        "from customer, (values ('plain'), ('screened')) as w(way) where c_custkey % 6 in (3, 4)",
        "run_history": with_(
            FULL_RUN,
            f"select * from (select r.*, lag(status) over (partition by layer, \"table\", validation order by run) as previous from ("
            f"select '2024-01' as run, layer, \"table\", validation, status from ({_run(_EVERY)}) "
            f"union all select '2024-02', layer, \"table\", validation, {_WITHOUT_NAME} from ({_run(_EVERY)})) r), "
            "lateral (select case when previous is null then 'new' "
            "when status in ('FAIL', 'ERROR') and previous = 'PASS' then 'broken' when status = previous then 'same' else 'changed' end as change)",
        ),
        "load_direct": "select * from orders",
        "load_cleanse": with_(
            [PS_ORDERS],
            "select o_orderkey, o_custkey, lower(trim(o_orderstatus)) as o_orderstatus, o_totalprice, o_orderdate, "
            "upper(trim(o_orderpriority)) as o_orderpriority from ps_orders",
        ),
        "load_reject": with_(stg, "select * from stg_orders"),
        "load_scd1": with_([CUSTOMER_VERSIONS], LOAD_SCD1),
        "load_scd2": with_([CUSTOMER_VERSIONS, CHANGED], LOAD_SCD2),
        "load_fact": with_([DIM_CUSTOMER], LOAD_FACT),
        "inject_defects": INJECT_DEFECTS,
        "inject_exact_numbers": with_([_EXACT], INJECT_EXACT),
        "bucketed_diffs": with_(ORDERS_SENSITIVE, _cell_diffs()),
        "check_volumes": with_(ALL_LAYERS, "\nunion all ".join(_rows_read(*at) for at in RUN_NAMES)),
        "existence_verdicts": with_(FULL_RUN, f"select layer, \"table\", validation, status from ({_run(_EVERY)})"),
        "restore_linked_tables": "select 'lineitem' as table_name, l_orderkey::bigint as row_key, l_extendedprice::double as amount from lineitem "
        "union all select 'orders', o_orderkey, o_totalprice from orders union all select 'supplier', s_suppkey, s_acctbal from supplier "
        "union all select 'customer', c_custkey, c_acctbal from customer "
        "union all select 'refused: orders.o_custkey', o_custkey, count(*)::double from orders "
        "where not exists (select 1 from customer where c_custkey = o_custkey and c_custkey % 50 <> 0) group by o_custkey",
    }
