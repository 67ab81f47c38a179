"""An extension: contracts over micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.model import ValidationResult
from plumbline.operators.rules import build_rules
from plumbline.sources.contracts import as_contract


def batch_validator(contract, on_result: Callable[[ValidationResult, int], None], **options) -> Callable[[DataFrame, int], None]:
    """A function for ``writeStream.foreachBatch`` that validates each micro-batch."""
    from plumbline.api import validate

    return lambda batch, batch_id: on_result(validate(batch, contract, **options), batch_id)


def observed(df: DataFrame, contract, name: str = "rules") -> DataFrame:
    """``df`` with an observed metric of violations for each rule of rows, measured while the rows pass."""
    masks = [(r.rule_id, m) for r in build_rules(as_contract(contract).rules) if (m := r.mask(df.schema)) is not None]
    return df.observe(name, F.count(F.lit(1)).alias("rows"), *[F.count_if(m).alias(i) for i, m in masks])
