"""Python code for executors that don't have the package installed."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship(module: str) -> None:
    """Pickle this module's functions by value: for every module whose functions run in Python workers."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
