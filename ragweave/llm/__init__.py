"""Operators for preparing training corpora; self-contained, imported by nothing else in the library."""
