"""Registered queries over the given tables."""

from .base import ORACLES, QUERIES  # noqa: F401
from . import (  # noqa: F401,E402
    carts, catalog, history, texts, identity, monitoring, files, streams,
)
