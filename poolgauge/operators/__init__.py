"""DataFrame operators over the panel."""
