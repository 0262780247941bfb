"""Functions of text, numbers, dates and vectors."""
