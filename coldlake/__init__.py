"""coldlake: an archive and query engine for rarely touched tables, built on PySpark."""

from __future__ import annotations

import importlib

__version__ = "0.1.0"

_EXPORTS = {
    "coldlake.api": (
        "append", "audit", "auto_select", "copy_archive", "detect", "diff", "freeze", "freeze_file", "freeze_stream", "peek",
        "profile", "query", "register", "registered", "set_path_resolver", "unfreeze", "unregister", "verify",
    ),
    "coldlake.operators.catalog": ("Catalog",),
    "coldlake.operators.contract": ("Contract", "Field", "SchemaError", "evolve", "schema_diff"),
    "coldlake.session": ("ArchiveSession",),
    "coldlake.sources.codecs": (
        "CODEC_AUTO", "CODEC_LZMA2", "CODEC_NONE", "CODEC_PROFILES", "CODEC_ZPAQ", "CODEC_ZSTD", "QUANT_HIGH", "QUANT_LOW",
        "QUANT_MEDIUM", "QUANT_NONE",
    ),
    "coldlake.sources.keys": ("EnvironmentKey", "FileKey", "KeyProvider", "StaticKey", "generate_key"),
}
_MODULES = {name: module for module, names in _EXPORTS.items() for name in names}
__all__ = sorted(_MODULES)


def __getattr__(name: str):
    if name in _MODULES:
        return getattr(importlib.import_module(_MODULES[name]), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
