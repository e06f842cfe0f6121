"""Typed parameters of each algorithm, and ``name=value`` texts.

``device``, ``max_queue_sizing``, ``threshold`` and ``with_value`` steer hardware that is not
there; they are accepted, so command lines that name them run, and change nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, fields, replace
from functools import reduce


IGNORED = ("device", "max_queue_sizing", "threshold", "with_value")


@dataclass(frozen=True)
class Common:
    """``run_CPU`` compares the result with a plain version in the driver."""

    iter_num: int = 2147483647
    verbose: bool = False
    stats: bool = False
    run_CPU: bool = False  # noqa: N815
    device: int = 0
    max_queue_sizing: float = 1.5
    threshold: int = 10000
    with_value: bool = False


@dataclass(frozen=True)
class Traversal(Common):
    """Parameters of BFS and SSSP; ``src`` counts from ``origin``."""

    src: int = 1
    origin: int = 1
    directed: bool = True
    num_src: int = 1


@dataclass(frozen=True)
class Components(Common):
    pass


@dataclass(frozen=True)
class Ranks(Common):
    """``tol`` is the relative error up to which ``run_CPU`` passes."""

    directed: bool = True
    damping: float = 0.85
    change_tol: float = 0.01
    tol: float = 0.1
    threshold: int = 1000


KINDS = {"bfs": Traversal, "sssp": Traversal, "cc": Components, "pagerank": Ranks}


def given(kind: str, text: str) -> dict[str, object]:
    """The ``name=value`` pairs between blanks, commas or lines, and only those, in their types.

    Unknown names and values of the wrong type raise ValueError.
    """
    types, out = {f.name: type(f.default) for f in fields(KINDS[kind])}, {}
    for pair in filter(None, re.split(r"[\s,]+", text)):
        name, eq, value = pair.partition("=")
        if not eq or name not in types:
            raise ValueError(f"unknown parameter {pair!r}; known: {', '.join(types)}")
        try:
            out[name] = bool(int(value)) if types[name] is bool else types[name](value)
        except ValueError:
            raise ValueError(f"{name} needs a value of type {types[name].__name__}, not {value!r}") from None
    return out


def parse(kind: str, *texts: str) -> Traversal | Components | Ranks:
    """Defaults of ``kind``, changed by the pairs of each text, later ones above earlier ones."""
    return reduce(lambda par, text: replace(par, **given(kind, text)), texts, KINDS[kind]())


def read_file(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()
