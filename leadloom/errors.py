"""Errors of the engine. Failures of single requests are rows, not errors."""


class LeadError(Exception):
    """Any error that the engine raises on its own account."""


class LoadError(LeadError):
    """Landed output can't be read, or holds nothing."""


class ProviderError(LeadError):
    """A service didn't answer as agreed."""


class AnswerError(ProviderError):
    """An answer isn't of the agreed form."""


class DailyLimitError(ProviderError):
    """A client has used up its requests of the day."""
