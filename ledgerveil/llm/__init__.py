"""Training-data operators: joins, filters, scoring, extraction, formatting, mixing. Nothing else in the library imports this package."""
