"""Query planning: bounds, neighbourhoods, selection of query positions."""
