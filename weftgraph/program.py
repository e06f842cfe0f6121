"""What a vertex program is: a few Column expressions and the directions of its edges."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F


class Along(Enum):
    """Which edges of a vertex are taken: those that leave it, those that enter it, all, none."""

    OUT = "out"
    IN = "in"
    ALL = "all"
    NONE = "none"


#: How values that meet at a vertex are combined: an aggregate that combines on the map side.
COMBINE: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "min": F.min, "max": F.max, "any": lambda c: F.any_value(c, True)}

State = dict[str, Column]
Get = Callable[[str], Column]


@dataclass(frozen=True)
class Program:
    """A superstep takes the active vertices and

    1. gathers ``gather_edge(neighbour, edge)`` over their edges, combined by ``gather_sum``,
       ``gather_identity`` where there is none;
    2. applies: ``apply(state, gathered or message, superstep)`` gives new state columns, and
       ``changed`` whether neighbours have to hear of it;
    3. expands the edges of changed vertices, of those only for which ``expand_vertex(state,
       superstep)`` holds, each with message ``expand_edge(state, edge)``, unless ``keep_edge(state,
       edge)`` is given and not true;
    4. contracts the messages at each vertex by ``combine``; where ``accept(state, message)``
       holds the vertex becomes active with that message, and ``contract`` may set its state.

    All functions get column accessors and give Columns, so every step stays in generated code.
    """

    init: Callable[[Column, Column], State]
    sources_only: bool = True
    gather: Along = Along.NONE
    gather_edge: Callable[[Get, Get], Column] | None = None
    gather_sum: str = "sum"
    gather_identity: object = None
    apply: Callable[[Get, Column, int], State] | None = None
    changed: Callable[[Get, State, Column, int], Column] | None = None
    expand: Along = Along.OUT
    expand_vertex: Callable[[Get, int], Column] | None = None
    expand_edge: Callable[[Get, Get], Column] | None = None
    keep_edge: Callable[[Get, Get], Column] | None = None
    combine: str = "any"
    accept: Callable[[Get, Column], Column] | None = None
    contract: Callable[[Get, Column, int], State] | None = None
    message_type: str = "bigint"
    max_supersteps: int | None = None
    extra: dict = field(default_factory=dict)
