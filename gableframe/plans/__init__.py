"""Multi-step jobs composed of columns and operators."""
