"""Files and tables."""
