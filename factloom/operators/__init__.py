"""Physical and logical operators over fact tables."""
