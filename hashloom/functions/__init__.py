"""functions of hashloom."""
