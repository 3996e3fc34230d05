"""Part of the claimloom engine."""
