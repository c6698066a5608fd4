"""pagelens: web-corpus analytics on PySpark DataFrames."""
