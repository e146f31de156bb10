"""DataFrame operators of the valuation engine."""
