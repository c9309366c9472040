"""All queries over the supplied tables and their SQL twins, by name."""

from __future__ import annotations

from importlib import import_module

THEMES = ("tags", "ranges", "series", "grids", "numbers", "more", "wider", "spectra", "fitted", "chains", "noisy")
_modules = [import_module(f"tallyfield.suite.{m}") for m in THEMES]
QUERIES: dict = {k: v for m in _modules for k, v in m.QUERIES.items()}
ORACLE: dict[str, str] = {k: v for m in _modules for k, v in m.ORACLE.items()}
