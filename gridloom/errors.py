"""What can go wrong, by kind."""


class PatternError(Exception):
    """Base of all errors of this package."""


class PaletteParse(PatternError):
    """A palette document that cannot be read."""


class InvalidPalette(PatternError):
    """A palette that breaks a rule."""


class ImageDecode(PatternError):
    """Bytes that are no image of a supported format."""


class InvalidImage(PatternError):
    """An image or a size that an operation cannot take."""


class ImageEncode(PatternError):
    """Pixels that cannot be written."""
