"""Curation of text datasets on Spark: embed once, inspect by similarity, mark rows, write the kept subset."""

from importlib import import_module

_EXPORTS = {
    "Dataset": "textcurate.plans.dataset",
    "load": "textcurate.plans.dataset",
    "status": "textcurate.plans.dataset",
    "finalize": "textcurate.plans.jobs",
    "pre_embed": "textcurate.plans.jobs",
    "prepare": "textcurate.plans.jobs",
}

__all__ = list(_EXPORTS)


def __getattr__(name: str):
    # On first use only: Python workers import this package for single functions and should start fast.
    if name not in _EXPORTS:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(_EXPORTS[name]), name)
