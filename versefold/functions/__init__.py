"""functions of versefold."""
