"""Whole plans: detection, editing, review, and hooks for outside services."""
