"""Part of tesserix."""
