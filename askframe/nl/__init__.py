"""The English front end: questions to plans."""
