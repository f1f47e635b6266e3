"""Column expressions: text, prompts."""
