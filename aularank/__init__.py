"""aularank: course recommendation and passage retrieval as Spark jobs.

Every public function takes and returns DataFrames; nothing is computed one
user at a time on the driver.  See README.md for the module map.
"""

import sys as _sys

from aularank.params import RecommenderParams, RouterParams  # noqa: F401

# Python functions handed to applyInPandas / pandas_udf are pickled by value,
# so executors need no copy of this package on their path.
try:
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older pyspark
    pass

__all__ = ["RecommenderParams", "RouterParams"]
