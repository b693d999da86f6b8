"""Column expressions: answers, texts and time codes, vectors, seeded draws."""
