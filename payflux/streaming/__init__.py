"""The same scoring on transactions that arrive as a stream."""
