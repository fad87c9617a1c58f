"""Part of the palette-grid engine."""
