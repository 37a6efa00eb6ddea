"""sitelake: page analytics on PySpark (node table, selectors as joins, link graphs, crawl frontiers)."""

import sys as _sys

try:  # ship the library's Python steps inside the tasks: executors need not have the package installed
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle: fall back to --py-files / addPyFile
    pass
