"""streaming of versefold."""
