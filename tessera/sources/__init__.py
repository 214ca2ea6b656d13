"""Readers that make records from files and captures, and writers for what is built from them."""
