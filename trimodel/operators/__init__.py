"""DataFrame-to-DataFrame operators: mutations and the shape of results."""
