"""Sources, sinks, and what is kept beside them."""
