"""Scripts over streams of bars."""
