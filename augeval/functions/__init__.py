"""Column functions (JVM-side expressions; no row-at-a-time Python)."""
