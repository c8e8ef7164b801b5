"""tesserix: robustness analytics on scored, multi-view datasets, as Spark plans."""
