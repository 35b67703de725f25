"""All taggers: importing this module registers them."""

from . import native_taggers, python_taggers, url_taggers  # noqa: F401
from .registry import add_tagger, attributes, load_modules, names, native, spans, tag, tagger_rows, tagger_table, with_attributes  # noqa: F401
