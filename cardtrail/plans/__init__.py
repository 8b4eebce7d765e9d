"""Multi-step plans: the transfer closure and the two-round flow."""
