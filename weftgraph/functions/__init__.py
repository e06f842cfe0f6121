"""Element-wise functions."""
