"""Readers and writers of sequence, alignment, class, gene and abundance files."""
