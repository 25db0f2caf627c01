"""Files as a stream."""
