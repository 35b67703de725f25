"""Taggers that are native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import strip, unit, whole
from .registry import native


@native("bytes_length_v1")
def bytes_length(text: Column, _id: Column) -> dict[str, Column]:
    """UTF-8 bytes of the text."""
    return {"bytes": whole(text, F.octet_length(text))}


@native("doc_count_v1")
def doc_count(text: Column, _id: Column) -> dict[str, Column]:
    """1 for each document."""
    return {"count": whole(text, 1.0)}


@native("char_length_v1")
def char_length(text: Column, _id: Column) -> dict[str, Column]:
    """Code points of the text."""
    return {"length": whole(text, F.length(text))}


@native("char_length_strip_ws_v1")
def char_length_strip(text: Column, _id: Column) -> dict[str, Column]:
    """Code points of the text without white space at its ends."""
    return {"length": whole(text, F.length(strip(text)))}


@native("random_number_v1")
def random_number(text: Column, doc_id: Column) -> dict[str, Column]:
    """A number from 0 up to 1, fixed by the document's id."""
    return {"random": whole(text, unit(doc_id, 97))}
