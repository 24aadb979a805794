"""Column functions: text in, column out; everything stays inside the JVM unless noted."""
