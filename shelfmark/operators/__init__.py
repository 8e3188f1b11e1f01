"""Set-based operators; each takes and returns DataFrames."""
