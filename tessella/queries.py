"""All image queries and their SQL; importing the modules registers them."""

import importlib

from tessella.registry import ORACLES, QUERIES

for _m in ("pointwise", "stencils", "geometry", "metrics", "frames", "images", "blocktypes"):
    importlib.import_module(f"tessella.operators.{_m}")

__all__ = ["ORACLES", "QUERIES"]
