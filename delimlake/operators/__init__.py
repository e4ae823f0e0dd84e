"""Records of delimited text, and sections of reports."""
