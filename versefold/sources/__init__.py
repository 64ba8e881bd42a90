"""sources of versefold."""
