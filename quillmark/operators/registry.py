"""A registry of operators with declared input and output columns.

An operator is a function from DataFrames to a DataFrame. Calls are checked before a
plan is made (the inputs' columns) and after (the output's), so a wrong extension
fails at once instead of in a task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


class ContractError(ValueError):
    """An operator was given or made other columns than it declares."""


@dataclass(frozen=True)
class Operator:
    name: str
    run: Callable[..., DataFrame]
    inputs: tuple[StructType, ...]
    output: StructType
    scopes: frozenset[str] = frozenset()
    version: str = "1.0.0"


@dataclass
class Registry:
    baseline: dict[str, Operator] = field(default_factory=dict)
    extensions: dict[str, Operator] = field(default_factory=dict)

    def register(self, operator: Operator) -> None:
        if operator.name in self.baseline:
            raise ContractError(f"{operator.name} is registered")
        self.baseline[operator.name] = operator

    def extend(self, operator: Operator) -> None:
        """Replace a baseline operator; its schemas must be equal and its scopes no wider."""
        base = self.baseline.get(operator.name)
        if base is None or (base.inputs, base.output) != (operator.inputs, operator.output):
            raise ContractError(f"{operator.name}: schemas differ from the baseline's")
        if not operator.scopes <= base.scopes:
            raise ContractError(f"{operator.name}: scopes beyond the baseline's")
        self.extensions[operator.name] = operator

    def invoke(self, name: str, *inputs: DataFrame, fallback: bool = False, scopes: frozenset[str] = frozenset()) -> DataFrame:
        """Call an operator on inputs pruned to its declared columns; a failing extension may fall back."""
        base = self.baseline[name]
        chosen = self.extensions.get(name, base)
        if not chosen.scopes <= scopes:
            raise ContractError(f"{name} needs {sorted(chosen.scopes - scopes)}")
        given = [self._pruned(name, df, want) for df, want in zip(inputs, chosen.inputs, strict=True)]
        try:
            return self._checked(name, chosen.run(*given), chosen.output)
        except Exception:
            if not fallback or chosen is base:
                raise
            return self._checked(name, base.run(*given), base.output)

    def describe(self) -> dict[str, dict]:
        return {n: {"version": o.version, "output": o.output.jsonValue(), "extended": n in self.extensions} for n, o in self.baseline.items()}

    @staticmethod
    def _pruned(name: str, df: DataFrame, want: StructType) -> DataFrame:
        have = {f.name: f.dataType for f in df.schema}
        if wrong := [f.name for f in want if have.get(f.name) != f.dataType]:
            raise ContractError(f"{name}: input lacks {wrong}")
        return df.select(*want.names)

    @staticmethod
    def _checked(name: str, df: DataFrame, want: StructType) -> DataFrame:
        if [(f.name, f.dataType) for f in df.schema] != [(f.name, f.dataType) for f in want]:
            raise ContractError(f"{name}: output is {df.schema.simpleString()}")
        return df
