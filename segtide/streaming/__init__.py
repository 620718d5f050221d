"""Search over streams of sequences."""
