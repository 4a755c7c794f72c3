"""Session options and plan texts."""
