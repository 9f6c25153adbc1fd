"""Products of matrices inside tasks."""

from __future__ import annotations

import ctypes
import functools
import glob
import os

import numpy as np


@functools.lru_cache(maxsize=1)
def one_thread() -> None:
    """Lets numpy's products of matrices use one thread in this process: Spark gives a task one core, and threads of all tasks
    would wait for each other.  Does nothing where numpy brings another library."""
    for path in glob.glob(os.path.join(os.path.dirname(np.__file__), "..", "numpy.libs", "*openblas*")):
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
