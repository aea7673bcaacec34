"""Column-returning scalar functions; all of them stay inside the JVM."""
