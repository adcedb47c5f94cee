"""operators of hashloom."""
