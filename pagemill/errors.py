"""Errors of the library. All derive from Exception, so ordinary handlers see them."""


class ConversionError(Exception):
    """A page or document could not be converted."""


class UnsupportedFileError(ConversionError):
    """The file is not a PDF."""


class UnsupportedModelError(ConversionError):
    """No provider is known for the model."""


class ModelCallError(ConversionError):
    """A provider failed, after all retries."""


class FigureError(ConversionError):
    """A raster could not be searched for figures."""
