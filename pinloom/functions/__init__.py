"""Part of pinloom."""
