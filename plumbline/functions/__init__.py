"""Column functions: text and answer extraction, arrays, scores, hashes."""
