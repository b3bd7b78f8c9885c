"""Column expressions: URLs, text, dates, numeric bands."""
