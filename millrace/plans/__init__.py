"""Physical layout of a log and the table facade over it."""
