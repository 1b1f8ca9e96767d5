"""Reading and writing the study's tables."""
