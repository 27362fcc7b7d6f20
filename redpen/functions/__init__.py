"""Column functions: text normalisation, tests on strings, ids and labels."""
