"""Part of blockwise."""
