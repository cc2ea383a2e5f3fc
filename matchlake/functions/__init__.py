"""Part of matchlake."""
