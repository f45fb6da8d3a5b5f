"""Types, coercion and formatting."""
