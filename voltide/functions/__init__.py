"""Part of voltide."""
