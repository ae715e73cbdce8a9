"""SQL that computes expected answers from the generating columns."""
