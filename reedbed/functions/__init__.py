"""Column expressions that stay in the JVM."""
