"""Graph algorithms as programs of the superstep engine."""
