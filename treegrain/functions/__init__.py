"""Part of treegrain."""
