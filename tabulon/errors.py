"""The one exception analyses raise for input they cannot work on."""


class AnalysisError(ValueError):
    """Bad input to an analysis: unknown column, wrong type, too little data."""
