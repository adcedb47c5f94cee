"""ml of hashloom."""
