"""SQL text builders.

Plans are assembled as SQL expressions: one long expression is one call into the JVM, where the same expression put
together from Column objects takes dozens, which for wide tables costs more than running the check.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping


def quoted(name: str) -> str:
    """A column name as SQL identifier."""
    return "`" + name.replace("`", "``") + "`"


def field(row: str, name: str) -> str:
    """A field of a struct column."""
    return f"{row}.{quoted(name)}"


def lit(text: str) -> str:
    """A string literal."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return f"'{escaped}'"


def aliased(columns: Mapping[str, str]) -> list[str]:
    """``{name: expression}`` as select list."""
    return [f"{expression} as {quoted(name)}" for name, expression in columns.items()]


def names(columns: Iterable[str]) -> list[str]:
    return [quoted(c) for c in columns]


def listed(columns: Iterable[str]) -> str:
    return ", ".join(quoted(c) for c in columns)


def concat(*parts: str) -> str:
    return f"concat({', '.join(parts)})"


def joined(separator: str, parts: Iterable[str]) -> str:
    """Join the parts that are not NULL."""
    return f"concat_ws({', '.join([lit(separator), *parts])})"


def case(choices: Iterable[tuple[str, str]], default: str = "null") -> str:
    """The value of the first condition that holds."""
    branches = " ".join(f"when {condition} then {value}" for condition, value in choices)
    return f"case {branches} else {default} end" if branches else default


def all_of(conditions: Iterable[str]) -> str:
    return " and ".join(f"({c})" for c in conditions) or "true"



def filled(template: str, **numbers: str) -> str:
    """Text with ``{name}`` placeholders for numeric expressions."""
    parts: list[str] = []
    rest = template
    while "{" in rest:
        before, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [lit(before), f"cast({numbers[name]} as string)"]
    return concat(*parts, lit(rest))


def python_list(values: Iterable[str]) -> str:
    """``['a', 'b']``, the form in which column lists appear in result messages."""
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"
