"""What a search can decline or reject, one class each."""

from __future__ import annotations


class SegtideError(Exception):
    """Base of all errors raised here."""


class InvalidCost(SegtideError):
    """A cost or threshold is negative, infinite or not a number."""


class InvalidThreshold(SegtideError):
    """A threshold of the greatest float leaves no room for a strict bound."""


class ThresholdUnavailable(SegtideError):
    """Deleting the whole query costs no more than the threshold, or no radius selects enough of it."""


class SearchTooExpensive(SegtideError):
    """More candidates than the limit."""

    def __init__(self, candidates: int, limit: int):
        super().__init__(f"{candidates} candidates exceed the limit of {limit}")
        self.candidates, self.limit = candidates, limit


class InvalidEmbeddingDimension(SegtideError):
    """A vector's length differs from the store's."""


class InvalidEmbeddingValue(SegtideError):
    """A vector holds a value that is not finite."""


class ZeroNormEmbedding(SegtideError):
    """A vector of norm zero has no direction."""


class CorruptIndex(SegtideError):
    """Corpus, postings and vocabulary disagree."""


class InvalidFile(SegtideError):
    """An input or snapshot does not have the form it should have."""


class UnsupportedVersion(InvalidFile):
    """A snapshot or configuration of another version."""


class TokenizerMismatch(SegtideError):
    """Costs were compiled for another tokeniser than the index's."""
