"""From a statement's text to a plan of DataFrame operations."""
