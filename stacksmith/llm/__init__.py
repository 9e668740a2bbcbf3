"""Training-data operators: scans, filters, near-duplicate joins, packing, scoring, formatting."""
