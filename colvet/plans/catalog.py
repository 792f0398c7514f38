"""Import every query module so its registrations land in ``REGISTRY``."""

from __future__ import annotations

import importlib

MODULES = ("q_woe", "q_tc", "q_describe", "q_shift", "q_segment", "q_catms", "q_frame", "q_rddm", "q_contract",
           "q_table")


def load():
    for m in MODULES:
        importlib.import_module(f"colvet.plans.{m}")
    from .registry import REGISTRY
    return REGISTRY
