"""Column functions: moments, intervals, relations, calendars, geometry, tags, text."""
