"""Operators on alignments, classes of fragments and abundances."""
