"""Functions for Python workers, found by name there, so that a worker needs no path but this package's own."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[2])


def shipped(module: str, name: str, *args) -> Callable:
    """A closure that imports module on the worker and calls the named function with what it is given and args."""
    root = ROOT

    def run(given):
        import importlib
        import sys

        if root not in sys.path:
            sys.path.insert(0, root)
        return getattr(importlib.import_module(module), name)(given, *args)

    return run


def given_back() -> None:
    """Memory that this process has freed goes back to the system; a worker that waits for its next task holds none of it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)(0)
