"""operators of versefold."""
