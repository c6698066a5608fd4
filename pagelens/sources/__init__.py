"""sources of pagelens."""
