"""Operators for preparing text for language-model training; nothing else imports this package."""
