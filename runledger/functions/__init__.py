"""Column rules and the skew-safe ordered scan shared by the operators."""
