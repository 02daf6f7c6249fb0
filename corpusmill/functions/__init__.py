"""Column expressions: features, tokens, hashes, vectors. All stay in the JVM."""
