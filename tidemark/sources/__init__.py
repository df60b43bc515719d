"""Where panels come from."""
