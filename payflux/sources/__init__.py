"""Where transactions come from and where results go."""
