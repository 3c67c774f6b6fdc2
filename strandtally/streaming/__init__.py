"""One-pass estimates over streams."""
