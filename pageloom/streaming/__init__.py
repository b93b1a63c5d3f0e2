"""Pages that arrive while others are cleaned."""
