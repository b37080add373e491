"""Algorithms by name: a decorator that registers a function over edges, and what the command line finds by it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Algorithm:
    name: str
    description: str
    run: Callable


ALGORITHMS: dict[str, Algorithm] = {}


def algorithm(name: str, description: str = "") -> Callable[[Callable], Callable]:
    def register(f: Callable) -> Callable:
        if name in ALGORITHMS:
            raise ValueError(f"there is an algorithm {name} already")
        ALGORITHMS[name] = Algorithm(name, description or (f.__doc__ or "").split("\n")[0], f)
        return f

    return register
