"""Reading panels and keeping results."""
