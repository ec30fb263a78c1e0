"""See README.md for the module map."""
