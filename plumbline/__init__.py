"""Contract-grounded table analytics as PySpark DataFrame operators."""

from .contract import (Contract, Exclusion, Expectation, ForeignKey, Measure, Window)
from .errors import Refused
from .operators.scope import Scope, scope_counts

__all__ = ["Contract", "Exclusion", "Expectation", "ForeignKey", "Measure", "Window",
           "Refused", "Scope", "scope_counts"]
