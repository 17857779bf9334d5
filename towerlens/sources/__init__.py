"""Reading alarm exports and keeping the history table."""
