"""The ``when`` grammar: one comparison of a column with a literal."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.literals import UNUSABLE, col, literal_for
from plumbline.model import ContractError

_GRAMMAR = re.compile(r"\s*([A-Za-z_]\w*)\s*(==|!=|>=|<=|>|<)\s*(.+?)\s*\Z", re.S)
_INT, _FLOAT = re.compile(r"[+-]?\d+\Z"), re.compile(r"[+-]?(\d+\.\d*|\.\d+|\d+(?=[eE]))([eE][+-]?\d+)?\Z")


@dataclass(frozen=True)
class Condition:
    column: str
    op: str
    value: Any

    def to_column(self, schema: T.StructType) -> Column:
        """True where the condition holds; never null."""
        c = col(self.column)
        if self.value is None:
            return {"==": c.isNull(), "!=": c.isNotNull()}.get(self.op, F.lit(False))
        value = literal_for(self.value, schema[self.column].dataType)
        if value is UNUSABLE:
            return c.isNotNull() if self.op == "!=" else F.lit(False)
        return F.coalesce(compared(c, self.op, F.lit(value)), F.lit(False))


def compared(a: Column, op: str, b: Column) -> Column:
    return {"==": a == b, "!=": a != b, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]


def parse(text: str) -> Condition:
    m = _GRAMMAR.match(text or "")
    if not m:
        raise ContractError(f"a condition is: column operator literal, not {text!r}")
    name, op, said = m.groups()
    if said[0] in "'\"":
        if len(said) < 2 or said[-1] != said[0] or said[0] in said[1:-1]:
            raise ContractError(f"unclosed or joined text in {text!r}; AND and OR aren't part of a condition")
        return Condition(name, op, said[1:-1])
    words = {"true": True, "false": False, "null": None, "none": None}
    if said.lower() in words:
        return Condition(name, op, words[said.lower()])
    if _INT.match(said):
        return Condition(name, op, int(said))
    if _FLOAT.match(said):
        return Condition(name, op, float(said))
    raise ContractError(f"{said!r} isn't a literal; AND and OR aren't part of a condition")
