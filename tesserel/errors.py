"""Refusals. Each names the construct it refuses; none is raised for a row."""

from __future__ import annotations


class TesserelError(ValueError):
    """Base of all refusals."""


class ParseError(TesserelError):
    """The text isn't a statement the parser knows."""


class Unsupported(TesserelError):
    """A construct that is refused by name when the plan is built."""


class NotRowWise(Unsupported):
    """A projection that would not give one row per row."""


class WholeTrainingSet(Unsupported):
    """The text needs all training rows when it is applied."""


class KeyNotUnique(TesserelError):
    """A fitted lookup has several rows for one key."""


class NotFitted(TesserelError):
    """transform before fit."""


class UnknownModel(TesserelError):
    """A model id that no fit produced."""
