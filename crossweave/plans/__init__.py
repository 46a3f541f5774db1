"""Panels made of the test tables, and the registered queries over them."""
