"""DataFrame operators.  Each takes and returns DataFrames; nothing is
collected except results whose size does not depend on the row count."""
