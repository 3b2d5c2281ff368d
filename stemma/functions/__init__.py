"""Part of the stemma package."""
