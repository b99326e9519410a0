"""Column functions: text clean-up with Python's string semantics, expressed
as built-in Spark expressions (JVM side, inside whole-stage codegen)."""
