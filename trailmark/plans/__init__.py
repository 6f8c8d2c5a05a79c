"""Named query plans over the shared tables, and their SQL oracles."""
