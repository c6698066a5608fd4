"""operators of pagelens."""
