"""The modules of the subpackage that have queries."""

from __future__ import annotations

import importlib
from types import ModuleType

NAMES = ("near_duplicates", "format_duplicates", "match_groups", "similarity_clusters", "bpe", "packing", "subjects")


def modules() -> list[ModuleType]:
    return [importlib.import_module(f"reedbed.llm.{x}") for x in NAMES]
