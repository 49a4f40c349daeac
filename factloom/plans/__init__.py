"""Query language and federated planning."""
