"""DataFrame operators; each module states its nulls, ties and skew rules."""
