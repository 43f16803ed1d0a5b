"""URLs: document predicate, prefixing, file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WHOLE = r"^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"
#: An authority with an opening bracket that is never closed is no URL.
_UNCLOSED = r"^[^/]*//[^/?#\]]*\[[^/?#\]]*([/?#]|$)"


def is_pdf_url(url: Column, strict_case: bool = False, suffix_only: bool = False) -> Column:
    """Whether a URL has a scheme and an authority and ends in .pdf; null has not.

    ``strict_case`` also asks for a suffix in lower case; ``suffix_only`` asks for nothing but that.
    """
    if suffix_only:
        return F.coalesce(F.endswith(url, F.lit(".pdf")), F.lit(False))
    fine = url.rlike(_WHOLE) & ~url.rlike(_UNCLOSED) & F.endswith(F.lower(url), F.lit(".pdf"))
    if strict_case:
        fine = fine & F.endswith(url, F.lit(".pdf"))
    return F.coalesce(fine, F.lit(False))


def absolute(href: Column, base: str, mode: str = "relative") -> Column:
    """A link with the host put before it: ``always``, if it is ``relative`` (begins with a slash), or ``not_http``."""
    prefixed = F.concat(F.lit(base), href)
    if mode == "always":
        return prefixed
    if mode == "relative":
        return F.when(F.startswith(href, F.lit("/")), prefixed).otherwise(href)
    if mode == "not_http":
        return F.when(~F.startswith(href, F.lit("http")), prefixed).otherwise(href)
    raise ValueError(mode)


def file_name(url: Column) -> Column:
    """The last part of a URL's path; where it is empty, a name made from the URL's hash."""
    path = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    name = F.regexp_extract(path, r"(?s)^([^?#]*)", 1)
    name = F.regexp_extract(name, r"([^/]*)$", 1)
    return F.when(name != "", name).otherwise(F.concat(F.lit("pdf_"), F.substring(F.md5(url), 1, 16), F.lit(".pdf")))
