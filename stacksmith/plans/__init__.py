"""Query plans over the driver tables, each with an equivalent DuckDB SQL."""
