"""Expression graphs and the ways to run them."""
