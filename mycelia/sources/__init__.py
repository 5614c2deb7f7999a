"""Where graphs and results come from and go to."""
