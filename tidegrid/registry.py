"""Operators and sources by name, and chains of them.

An operator is a function of a DataFrame and options that gives a DataFrame. Those of this package are registered under the names of
their functions; `register` adds others.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

from tidegrid.operators import coastlines, filters, rasters, rings, splines, stacks, surfaces, triangles
from tidegrid.plans import chains
from tidegrid.sources import manifest, readers, surveys, tiff

#: What the first parameter of an operator, and of a source, is called.
_FIRST = {"points": "operator", "cells": "operator", "beams": "operator", "lines": "operator", "spark": "source"}
_KNOWN: dict[str, tuple[str, Callable, dict]] = {}


def register(name: str, function: Callable, kind: str = "operator", **about: str) -> None:
    """Add an operator or source; a name that is taken is an error. `about`: anything to know of it, as a category."""
    if name in _KNOWN:
        raise ValueError(f"{name} is registered already")
    _KNOWN[name] = (kind, function, about)


def known(kind: str | None = None) -> dict[str, dict]:
    """Names with what is known of each: its kind, the first line of its docstring, its options, and what it was registered with."""
    return {
        name: {"kind": k, "doc": (f.__doc__ or "").partition("\n")[0], "options": list(inspect.signature(f).parameters)[1:], **about}
        for name, (k, f, about) in sorted(_KNOWN.items())
        if kind in (None, k)
    }


def get(name: str) -> Callable:
    if name not in _KNOWN:
        raise KeyError(f"no operator or source {name}")
    return _KNOWN[name][1]


def chain(df: DataFrame, steps: Iterable[tuple[str, dict]]) -> DataFrame:
    """`df` through the named operators, each with its options."""
    for name, options in steps:
        df = df.transform(get(name), **options)
    return df


for _module in (filters, rasters, stacks, surfaces, triangles, splines, rings, coastlines, chains, readers, surveys, manifest, tiff):
    for _name, _function in inspect.getmembers(_module, inspect.isfunction):
        _kind = _FIRST.get(next(iter(inspect.signature(_function).parameters), ""))
        if _kind and _function.__module__ == _module.__name__ and not _name.startswith("_"):
            register(_name, _function, _kind, category=_module.__name__.rpartition(".")[2])
