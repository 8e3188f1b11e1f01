"""Column functions: cleaning, text and vectors. All of them stay inside the JVM."""
