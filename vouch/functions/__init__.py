"""Part of vouch."""
