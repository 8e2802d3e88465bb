"""Reading and writing of tokenizer definitions and vocabularies."""
