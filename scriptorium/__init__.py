"""Post-correction and evaluation of recognised text lines on Spark."""
