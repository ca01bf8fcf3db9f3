"""Registered queries, one module per SURVEY section."""

from __future__ import annotations

import importlib

MODULES = [
    "q_corpus",
    "q_batch",
    "q_assemble",
    "q_analyze",
    "q_text",
    "q_vocab",
    "q_embed",
    "q_align",
    "q_signal",
    "q_quality",
    "q_stream",
    "q_sources",
    "q_sinks",
    "q_numbers",
]


def load_all():
    for m in MODULES:
        importlib.import_module(f"voxframe.plans.{m}")
    from voxframe.plans.registry import ORACLE, QUERIES

    return QUERIES, ORACLE
