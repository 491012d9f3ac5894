"""Text predicates, file names, titles and number formats."""

from functools import reduce
from operator import or_

from pyspark.sql import functions as F

from nitrogrid import constants as K


def any_of(conditions):
    return reduce(or_, conditions, F.lit(False))


def contains_any(column, keywords):
    """False for null input."""
    return F.coalesce(any_of([column.contains(k) for k in keywords]), F.lit(False))


def na_to_null(column, tokens=None):
    return F.when(~column.isin(K.NA_TOKENS if tokens is None else tokens), column)


def blank_to_null(column):
    trimmed = F.trim(column.cast("string"))
    return F.when(trimmed != "", trimmed)


def base_name(path):
    return F.regexp_extract(path, "([^/]*)$", 1)


def url_file_name(url):
    """Last segment of the URL's path; empty for a path that ends in a slash or is absent."""
    return F.coalesce(base_name(F.try_parse_url(url, F.lit("PATH"))), F.lit(""))


def download_file_name(url, position):
    """File name for a download; ``position`` (0-based) numbers the unnamed ones."""
    name = url_file_name(url)
    return F.when(name.endswith(K.GRANULE_SUFFIX), name).otherwise(
        F.format_string(K.FALLBACK_FILE_NAME, position + 1)
    )


def title_from_snake(column):
    return F.initcap(F.replace(column, F.lit("_"), F.lit(" ")))


def scientific(column):
    """Display text such as ``1.06e+15``."""
    return F.when(column.isNotNull(), F.format_string("%.2e", column))


def fixed3(column):
    """Display text such as ``40.713``."""
    return F.when(column.isNotNull(), F.format_string("%.3f", column))


def stamp(time):
    """Time suffix used in default output names."""
    return F.date_format(time, "yyyyMMdd_HHmmss")


def plain_path(path):
    """One form for the ways to write a local path: ``/d/f``, ``file:/d/f``, ``file:///d/f``."""
    return F.regexp_replace(F.trim(path), "^file:/+", "/")


_SCHEME = "^([A-Za-z][A-Za-z0-9+.-]*):/"


def path_scheme(path):
    """Scheme of a path; a path without one has the empty scheme, and so has a ``file:`` path."""
    scheme = F.lower(F.regexp_extract(F.trim(path), _SCHEME, 1))
    return F.when(scheme == "file", F.lit("")).otherwise(scheme)


def path_authority(path):
    """Host or bucket of a path with a scheme, else empty."""
    return F.lower(F.regexp_extract(F.trim(path), "^[A-Za-z][A-Za-z0-9+.-]*://([^/]*)/", 1))


def path_part(path):
    """A path without scheme and authority, with single slashes."""
    bare = F.regexp_replace(F.trim(path), "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?(?=/)", "")
    return F.regexp_replace(bare, "/+", "/")


def decoded_path(path):
    """A path with its percent escapes resolved; a plus sign stays one, bad escapes stay as they are."""
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
