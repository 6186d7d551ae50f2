"""Jobs of the domain, composed from operators and functions."""
