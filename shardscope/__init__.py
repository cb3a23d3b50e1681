"""Analytics over labelled tables that are split between several owners ("clients")."""
