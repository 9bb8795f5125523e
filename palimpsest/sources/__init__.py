"""Where changes come from and the log is kept."""
