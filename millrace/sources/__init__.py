"""Where mutation logs come from and where runs are kept."""
