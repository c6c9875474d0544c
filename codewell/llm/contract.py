"""Query modules of this subpackage."""

from __future__ import annotations

import importlib

_NAMES = ("q_split", "q_terms", "q_tokens", "q_names", "q_clusters", "q_vectors", "q_leaks", "q_abuse")


def modules() -> list:
    """Modules with QUERIES and SQL."""
    return [importlib.import_module(f"codewell.llm.{n}") for n in _NAMES]
