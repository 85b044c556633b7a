"""Reading event data."""
