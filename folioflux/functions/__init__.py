"""Column expressions: text, hashing, vectors, prompts. All of them stay inside Spark's expressions."""
