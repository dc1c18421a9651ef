"""Data-quality rules: each name maps to a builder ``(value, type, setting) -> SQL condition``, true where broken."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import types as T

from tallymark.functions.normalize import as_text, strip, without_nan
from tallymark.functions.text import lit, quoted
from tallymark.spec import RuleSpec

RuleBuilder = Callable[[str, T.DataType, Any], str]

_RULES: dict[str, RuleBuilder] = {}


def register_rule(name: str, builder: RuleBuilder) -> None:
    """Add a rule of your own, or replace one."""
    _RULES[name] = builder


def rule_names() -> list[str]:
    return list(_RULES)


def _not_null(value: str, dtype: T.DataType, setting: Any) -> str:
    return f"{without_nan(value, dtype)} is null"


def _text(value: str, dtype: T.DataType) -> str:
    return as_text(without_nan(value, dtype), dtype)


def _no_whitespace(value: str, dtype: T.DataType, setting: Any) -> str:
    text = _text(value, dtype)
    return f"{text} != {strip(text)}"


def _length_equals(value: str, dtype: T.DataType, setting: Any) -> str:
    return f"char_length({_text(value, dtype)}) != {int(setting)}"


def _in_set(value: str, dtype: T.DataType, setting: Any) -> str:
    allowed = ", ".join(lit(str(v)) for v in setting)
    return f"{_text(value, dtype)} not in ({allowed})" if allowed else f"{value} is not null"


def _min_value(value: str, dtype: T.DataType, setting: Any) -> str:
    limit = f"{float(setting)!r}D"
    if isinstance(dtype, T.NumericType):
        return f"cast({without_nan(value, dtype)} as double) < {limit}"
    # Text that is not a number cannot satisfy a numeric limit.
    return f"{value} is not null and coalesce(try_cast({value} as double) < {limit}, true)"


def _regex(value: str, dtype: T.DataType, setting: Any) -> str:
    # Anchored at the start only; a plain rlike would search anywhere.
    pattern = rf"\A(?:{setting})"
    return f"not ({_text(value, dtype)} rlike {lit(pattern)})"


register_rule("not_null", _not_null)
register_rule("no_whitespace", _no_whitespace)
register_rule("length_equals", _length_equals)
register_rule("in_set", _in_set)
register_rule("min_value", _min_value)
register_rule("regex", _regex)


def broken(rule: RuleSpec, schema: T.StructType) -> str:
    """Condition that is true where ``rule`` is broken and false otherwise (NULL passes all but not_null)."""
    if rule.rule not in _RULES:
        raise ValueError(f"Unknown transformation rule '{rule.rule}'")
    condition = _RULES[rule.rule](quoted(rule.column), schema[rule.column].dataType, rule.value)
    return f"coalesce({condition}, false)"
