"""Token, interval and structure operators."""
