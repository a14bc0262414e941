"""Options and the load plan."""
