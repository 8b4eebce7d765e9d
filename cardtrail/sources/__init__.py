"""Inputs: the transaction history, the test-table view, card lists."""
