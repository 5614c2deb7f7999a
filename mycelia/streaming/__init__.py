"""Components of a graph whose edges arrive over time."""
