"""Operators for preparing training data: each module holds one operator, its thin query and, where SQL can say it, its SQL."""
