"""Phase analytics over indexed collections, as DataFrame operators."""
