"""Training-data operators over a documents table; nothing outside this folder imports it."""
