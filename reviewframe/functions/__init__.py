"""Column-to-column functions; all run on the JVM."""
