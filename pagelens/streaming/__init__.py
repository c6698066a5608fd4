"""streaming of pagelens."""
