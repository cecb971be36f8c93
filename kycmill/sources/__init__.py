"""Table readers and the domain views built from them."""
