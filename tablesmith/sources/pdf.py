"""Text of PDF files: whitespace rules and titles; extraction is a pluggable function."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F


def clean_text(text: str) -> str:
    """Up to two line breaks in a row (\\r counts as one), other white space as one blank, none after either; trimmed."""
    out, breaks = [], 0
    for ch in text:
        if ch in "\r\n":
            breaks += 1
            if breaks <= 2:
                out.append("\n")
        elif ch.isspace():
            breaks = 0
            if out and out[-1] not in " \n":
                out.append(" ")
        else:
            breaks = 0
            out.append(ch)
    return "".join(out).strip()


def simple_text(data: bytes) -> str:
    """The literal strings shown in a PDF's plain or deflated content streams; no text: empty."""
    found = []
    for head, body in re.findall(rb"<<(.*?)>>\s*stream\r?\n(.*?)endstream", data, re.S):
        if b"FlateDecode" in head:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        for line in re.findall(rb"\(((?:\\.|[^\\()])*)\)\s*(?:Tj|')|\[((?:\((?:\\.|[^\\()])*\)|[^\]])*)\]\s*TJ", body):
            raw = line[0] or b"".join(re.findall(rb"\(((?:\\.|[^\\()])*)\)", line[1]))
            found.append(re.sub(rb"\\([()\\])", rb"\1", raw).decode("latin-1"))
    return "\n".join(found)


def reader(extract: Callable[[bytes], str] = simple_text, most_chars: int = 500_000):
    """A column function (binary content) -> text; a file that can't be read gives an empty text."""

    @F.pandas_udf("string")
    def pdf_text(content: pd.Series) -> pd.Series:
        def one(data) -> str:
            try:
                return clean_text(extract(bytes(data))[:most_chars]) if data is not None else ""
            except ValueError:
                return ""

        return content.map(one)

    return pdf_text
