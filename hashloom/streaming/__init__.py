"""streaming of hashloom."""
