"""DataFrame-in / DataFrame-out operators, grouped by kind."""
