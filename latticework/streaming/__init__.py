"""Dependencies are properties of a whole, bounded table; there is nothing to run on a stream yet."""
