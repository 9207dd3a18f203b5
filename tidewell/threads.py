"""Linear algebra in one thread.

A process that has started a JVM can block for ever in threaded linear algebra, and every Spark driver is such a
process; tasks share their machine with others anyway. The library's own matrices are small.
"""

from __future__ import annotations

import ctypes
import os
from glob import glob

import numpy as np

CALLS = ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads")


def one_thread() -> int:
    """Limit numpy's linear algebra to one thread, also after numpy is loaded; how many libraries were found."""
    found = 0
    for name in glob(f"{os.path.dirname(np.__file__)}.libs/*openblas*"):
        library = ctypes.CDLL(name)
        limit = next((getattr(library, c) for c in CALLS if hasattr(library, c)), None)
        if limit is not None:
            limit(1)
            found += 1
    return found
