"""Column expressions: every function takes and returns ``Column`` objects and stays in the JVM."""
