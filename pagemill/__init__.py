"""pagemill: a Spark-native engine that turns paged documents into markdown."""

from __future__ import annotations

import importlib
from typing import Any

__version__ = "0.2.0"

#: Public name -> where it is. Loaded when asked for, so that Python workers import only what they run.
_PUBLIC = {
    "Converter": ("pagemill.plans.converter", "Converter"),
    "Options": ("pagemill.config", "Options"),
    "PageConfig": ("pagemill.config", "PageConfig"),
    "SUPPORTED_MODELS": ("pagemill.operators.registry", "STATIC_MODELS"),
    "ConversionError": ("pagemill.errors", "ConversionError"),
    "FigureError": ("pagemill.errors", "FigureError"),
    "ModelCallError": ("pagemill.errors", "ModelCallError"),
    "UnsupportedFileError": ("pagemill.errors", "UnsupportedFileError"),
    "UnsupportedModelError": ("pagemill.errors", "UnsupportedModelError"),
}
__all__ = [*_PUBLIC, "__version__"]


def __getattr__(name: str) -> Any:
    if name not in _PUBLIC:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    module, attribute = _PUBLIC[name]
    return getattr(importlib.import_module(module), attribute)
