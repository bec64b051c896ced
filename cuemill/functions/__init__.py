"""Part of cuemill."""
