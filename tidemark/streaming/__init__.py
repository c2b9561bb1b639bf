"""The detection operators over unbounded input."""
