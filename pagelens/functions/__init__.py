"""functions of pagelens."""
