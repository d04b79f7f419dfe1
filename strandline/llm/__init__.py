"""Operators for training data: survivorship, linking, encoding, mixing, language labels."""
