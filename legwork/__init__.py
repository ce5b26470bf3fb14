"""DataFrame operators for passenger-load analytics on scheduled transport, and queries that use them."""
