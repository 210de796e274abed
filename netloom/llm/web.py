"""Page addresses and page text, for the operators that read raw web pages."""

from __future__ import annotations

import html
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SILENT = re.compile(r"<(script|style|head|template|noscript)\b.*?</\1\s*>|<!--.*?-->", re.S | re.I)
_BREAK = re.compile(r"</?(?:p|div|li|ul|ol|h[1-6]|tr|table|br|article|section|nav|footer|header|blockquote|pre|title|td|th)\b[^>]*>", re.I)
_TAG = re.compile(r"<[^>]*>")


def visible(page: str) -> str:
    """The text of a page: block elements end lines, scripts, styles and comments go."""
    return html.unescape(_TAG.sub("", _BREAK.sub("\n", _SILENT.sub("\n", page))))


def host(url: Column) -> Column:
    """Lower-case host without port or user; the empty string where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    """host/path without query, fragment or doubled slashes; null stays null."""
    bare = F.regexp_replace(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^?#]*)", 1), "/{2,}", "/")
    return F.when(url.isNotNull(), F.concat(F.lower(F.substring_index(bare, "/", 1)), F.regexp_extract(bare, "^[^/]*(/.*)?$", 1)))
