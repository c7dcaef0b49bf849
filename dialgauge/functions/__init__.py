"""Row functions: packed times, classes, operators, rates."""
