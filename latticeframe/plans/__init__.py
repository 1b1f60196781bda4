"""What is registered: operators by name, and queries over the sample tables."""
