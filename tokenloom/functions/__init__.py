"""Components of a tokenizer: each works on one string and as a Column expression."""
