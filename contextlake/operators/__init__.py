"""DataFrame and Column operators."""
