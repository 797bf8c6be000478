"""Column expressions: text clean-up, normalisation, artifact names, prompts and replies."""
