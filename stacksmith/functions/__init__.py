"""Column-level helpers (JVM-side expressions only)."""
