"""Measures data: rules, profiles, comparisons and run history on Spark DataFrames."""

from plumbline import rules  # noqa: F401
from plumbline.api import *  # noqa: F403
from plumbline.model import Contract, ContractError, RuleSpec, ValidationFailed, ValidationResult  # noqa: F401
from plumbline.operators.history import HistoryStore  # noqa: F401
from plumbline.operators.rules import Rule, register_rule  # noqa: F401
from plumbline.sources.datasets import Query, SourceSpec, load  # noqa: F401

__version__ = "0.1.0"
