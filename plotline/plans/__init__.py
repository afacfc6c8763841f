"""Composite plans: the listing cleaning chain, the feature plan and the
driver-table queries."""
