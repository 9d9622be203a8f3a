"""Column functions: text, ids and markup."""
