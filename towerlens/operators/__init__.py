"""DataFrame operators: cleaning, sequences, sliding windows, interval analysis, audits, models."""
