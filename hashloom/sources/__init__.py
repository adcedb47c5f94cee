"""sources of hashloom."""
