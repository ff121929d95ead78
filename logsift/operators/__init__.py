"""Log operators: each takes DataFrames (+ options) and returns a lazy DataFrame."""
