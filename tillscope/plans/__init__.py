"""The named queries over the order-processing tables and their SQL oracles."""
