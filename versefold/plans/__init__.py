"""plans of versefold."""
