"""Running compiled scripts on tables of bars."""
