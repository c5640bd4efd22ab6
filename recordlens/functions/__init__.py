"""Column functions; every one is a built-in expression that stays in the JVM."""
