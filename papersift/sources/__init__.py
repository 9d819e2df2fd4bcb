"""Sources: S1-S7."""
