"""Column-to-column functions; everything stays inside JVM code generation."""
