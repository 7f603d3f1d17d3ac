"""auditora: data-quality, privacy, fairness and explainability audits as Spark jobs.

Operators take DataFrames and return tidy DataFrames built from Spark expressions.
"""

from __future__ import annotations

import sys as _sys

try:  # ship this package's Python helpers (pandas UDFs) to workers by value
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle without the API
    pass

__all__ = ["session"]
