"""llm of hashloom."""
