"""Part of framewright."""
