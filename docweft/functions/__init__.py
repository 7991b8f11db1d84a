"""Column functions: text, dates, numbers, maps and JSON. All are JVM-side expressions."""
