"""Column -> Column functions; nothing here leaves the JVM."""
