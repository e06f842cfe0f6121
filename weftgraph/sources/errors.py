"""What can be wrong with a graph file."""


class GraphFileError(ValueError):
    """Any fault of a graph file."""


class BadHeader(GraphFileError):
    """The header or size line is missing or cannot be read."""


class NotSquare(GraphFileError):
    """A graph's matrix has unequal numbers of rows and columns."""


class WrongCount(GraphFileError):
    """The file holds more or fewer edges than it declares."""


class BadEdge(GraphFileError):
    """An edge line cannot be read."""


class BadVertex(GraphFileError):
    """An edge names a vertex beyond the declared number."""


class SpliceMismatch(GraphFileError):
    """Parts of one graph disagree on the number of vertices."""


class NoGraph(GraphFileError):
    """The file has no header at all."""
