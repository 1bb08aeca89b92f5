"""Column functions: text patterns, stored dates, units, enumerations and bulk data."""
