"""Column expressions: dates, units, text and geometry headers. All built-in Spark functions."""
