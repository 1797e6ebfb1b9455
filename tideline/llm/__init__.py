"""Operators for building text training data, and two numeric ones that go with them. Nothing else imports this package."""
