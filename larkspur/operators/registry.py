"""Capability definitions from this package and from installed extensions."""

from __future__ import annotations

import logging
from collections.abc import Iterable
from importlib.metadata import entry_points

from .reporting import CAPABILITIES, PROBE_CAPABILITIES, Capability

GROUP = "larkspur.capabilities"
_log = logging.getLogger(__name__)


def _of(found: object) -> tuple[Capability, ...]:
    if isinstance(found, Capability):
        return (found,)
    listed = getattr(found, "CAPABILITIES", found)
    return tuple(listed) if isinstance(listed, Iterable) else ()


def merge(base: Iterable[Capability], more: Iterable[object]) -> tuple[Capability, ...]:
    """Base first; an extension whose id is taken is dropped with a warning."""
    out = {c.id: c for c in base}
    for found in more:
        for c in _of(found):
            if c.id in out:
                _log.warning("capability %s is defined already", c.id)
            else:
                out[c.id] = c
    return tuple(out.values())


def capabilities() -> tuple[Capability, ...]:
    return merge((*CAPABILITIES, *PROBE_CAPABILITIES), (e.load() for e in sorted(entry_points(group=GROUP), key=lambda e: e.name)))
