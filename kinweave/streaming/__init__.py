"""What runs unchanged on streams."""
