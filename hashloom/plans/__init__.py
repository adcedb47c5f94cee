"""plans of hashloom."""
