"""Logging of the command line, by the environment."""

from __future__ import annotations

import logging
import os

LOG = logging.getLogger("millrace")


def setup(default: str = "INFO") -> int:
    """Set the root level to the environment's LOG_LEVEL, or the default where that is unset or unknown; the level that was set."""
    names = logging.getLevelNamesMapping()
    level = names.get(os.environ.get("LOG_LEVEL", default).upper(), names.get(default.upper(), logging.INFO))
    logging.basicConfig(format="%(asctime)s %(levelname)s %(name)s: %(message)s")  # does nothing where handlers exist
    root = logging.getLogger()
    for x in (root, *root.handlers):
        x.setLevel(level)
    return level
