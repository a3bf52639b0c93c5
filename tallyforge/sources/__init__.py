"""Tables and the views that queries start from."""
