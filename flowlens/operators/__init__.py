"""DataFrame operators. Each takes and returns DataFrames; nothing collects row-sized data."""
