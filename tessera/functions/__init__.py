"""Column expressions: everything stays in the JVM."""
