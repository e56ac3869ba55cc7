"""Languages: expressions, patterns, commands and programs."""
