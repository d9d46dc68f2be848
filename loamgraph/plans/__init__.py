"""Session set-up, table access and the shared working folder."""
