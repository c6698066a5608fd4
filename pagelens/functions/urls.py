"""URL expressions. All are Columns over RFC 3986 parts cut out by regular expressions, so that urls
with blanks or without a scheme still give an answer; a null url gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.-]*):"
AUTHORITY = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)"
PATH = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"
QUERY = r"^[^?#]*\?([^#]*)"
FRAGMENT = r"#(.*)$"
#: Labels of a host that name no site.
STOP_LABELS = ("www", "com", "org", "net", "info", "biz", "edu", "gov", "co", "m", "eu", "io")
#: Two-label public suffixes that the registered domain keeps a third label for; replace it by a full list where needed.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "co.jp", "com.br", "co.nz", "co.za", "com.tr")
SKIPPED_FILES = r"\.(jpg|png|pdf|js|css|gif)$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, SCHEME, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, AUTHORITY, 1)


def host(url: Column) -> Column:
    """Lower-case host without user, port or a final dot; urls without a scheme start with their host."""
    with_slashes = F.when(url.rlike(r"^([a-zA-Z][a-zA-Z0-9+.-]*:)?//"), url).otherwise(F.concat(F.lit("//"), url))
    return F.lower(F.regexp_replace(authority(with_slashes), r"^[^@]*@|:[0-9]*$|\.$", ""))


def path(url: Column) -> Column:
    return F.regexp_extract(url, PATH, 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, QUERY, 1)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, FRAGMENT, 1)


def strip_slashes(url: Column) -> Column:
    """The url as a join key: without the slashes at its end."""
    return F.regexp_replace(url, r"/+$", "")


def normalized(url: Column) -> Column:
    """``scheme://authority/path`` in lower case, without final slashes, query and fragment."""
    bare = strip_slashes(path(url))
    return F.lower(F.concat(scheme(url), F.lit("://"), authority(url), F.when(bare == "", "/").otherwise(bare)))


def with_scheme(url: Column, lower: bool = False) -> Column:
    """A url of a list: https is put before one without a scheme (http before localhost); others stay, or are normalised."""
    trimmed = F.trim(url)
    known = normalized(trimmed) if lower else trimmed
    return F.when(trimmed.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), known).otherwise(F.concat(F.when(trimmed.startswith("localhost"), "http://").otherwise("https://"), trimmed))


def registrable_domain(url: Column) -> Column:
    """The last two labels of the host; a one-label host stays."""
    return F.array_join(F.slice(F.split(host(url), r"\."), F.greatest(F.lit(-2), -F.size(F.split(host(url), r"\."))), F.lit(2)), ".")


def registered_domain(url: Column, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    """Domain and public suffix; empty when the host has no suffix. ``suffixes`` are those of two labels."""
    labels = F.split(host(url), r"\.")
    keep = F.when(F.array_join(F.slice(labels, F.greatest(F.lit(-2), -F.size(labels)), F.lit(2)), ".").isin(*suffixes), 3).otherwise(2)
    return F.when(F.size(labels) >= keep, F.array_join(F.slice(labels, -keep, keep), ".")).otherwise("")


def homepage(url: Column) -> Column:
    return F.concat(F.when(scheme(url).isin("http", "https"), scheme(url)).otherwise("https"), F.lit("://"), registered_domain(url), F.lit("/"))


def is_homepage(url: Column) -> Column:
    return path(url).isin("", "/") & (query(url) == "")


def name_parts(text: Column) -> Column:
    """Lower-case alphanumeric parts of more than two characters that are not numbers."""
    return F.filter(F.split(F.lower(F.substring(F.trim(text), 1, 40)), "[^a-z0-9]+"), lambda x: (F.length(x) > 2) & ~x.rlike("^[0-9]+$"))


def name_tokens(text: Column) -> Column:
    """The parts and, where there are two or more, the parts joined by a hyphen (40 characters at most)."""
    parts = name_parts(text)
    joined = F.array_join(parts, "-")
    return F.concat(parts, F.when((F.size(parts) >= 2) & (F.length(joined) <= 40), F.array(joined)).otherwise(F.array().cast("array<string>")))


def host_tokens(url: Column) -> Column:
    return F.flatten(F.transform(F.filter(F.split(host(url), r"\."), lambda x: ~x.isin(*STOP_LABELS)), name_tokens))


def path_tokens(url: Column) -> Column:
    """Name tokens of all segments but the last."""
    segments = F.filter(F.split(path(url), "/"), lambda x: x != "")
    return F.flatten(F.transform(F.slice(segments, F.lit(1), F.greatest(F.size(segments) - 1, F.lit(0))), name_tokens))


def file_tokens(url: Column) -> Column:
    """Name tokens of the last segment's stem and ``ext:`` of its extension; nothing without a dot."""
    last = F.element_at(F.split(path(url), "/"), -1)
    extension = F.lower(F.regexp_extract(last, r"\.([^.]*)$", 1))
    stem = F.regexp_replace(last, r"\.[^.]*$", "")
    known = F.when((extension != "") & (F.length(extension) <= 5), F.array(F.concat(F.lit("ext:"), extension))).otherwise(F.array().cast("array<string>"))
    return F.when(last.contains("."), F.concat(name_tokens(stem), known)).otherwise(F.array().cast("array<string>"))


def href_shape(href: Column) -> Column:
    """How a link is written, as tokens of fixed format: extension, number of parameters and their names, fragment, numbers, final slash, mail, script, template, depth."""
    query = F.regexp_extract(href, r"(?s)^[^?]*\?(.*)$", 1)
    pairs = F.split(query, "&")
    keys = F.filter(F.transform(F.slice(pairs, 1, 6), lambda x: F.lower(F.regexp_extract(x, "(?s)^([^=]*)", 1))), lambda k: F.length(k) <= 16)
    extension = F.lower(F.regexp_extract(href, r"\.([A-Za-z0-9]{1,5})(?:[?#]|$)", 1))
    segments = F.filter(F.split(F.regexp_extract(href, r"(?s)^([^?]*)", 1), "/"), lambda x: x != "")
    none = F.array().cast("array<string>")
    flags = F.array_compact(F.array(
        F.when(href.contains("#"), "H:frag"), F.when(href.rlike(r"/[0-9]{1,8}([./]|$)"), "H:numseg"), F.when(href.endswith("/"), "H:slash"), F.when(href.startswith("mailto:"), "H:mailto"),
        F.when(href.startswith("javascript:"), "H:jscript"), F.when(href.rlike("[{}]|%d"), "H:template"), F.concat(F.lit("H:depth="), F.greatest(F.lit(0), F.least(F.size(segments) - 2, F.lit(8))).cast("string")),
    ))
    parameters = F.when(query != "", F.concat(F.array(F.concat(F.lit("H:q="), F.least(F.size(pairs), F.lit(6)).cast("string"))), F.transform(keys, lambda k: F.concat(F.lit("H:key="), k)))).otherwise(none)
    return F.when(href == "", none).otherwise(F.concat(F.when(extension != "", F.array(F.concat(F.lit("H:ext="), extension))).otherwise(none), parameters, flags))


def resolved(base: Column, href: Column) -> Column:
    """``href`` against its page: absolute, scheme-relative, root-relative, query, fragment or relative to the folder."""
    root = F.concat(scheme(base), F.lit("://"), authority(base))
    folder = F.regexp_replace(F.when(path(base) == "", "/").otherwise(path(base)), "[^/]*$", "")
    return (
        F.when(href.rlike(SCHEME), href)
        .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?"), F.concat(root, path(base), href))
        .when(href.startswith("#") | (href == ""), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .otherwise(F.concat(root, folder, href))
    )


def is_external(base: Column, href: Column) -> Column:
    """Another registrable domain; relative links are internal."""
    absolute = href.rlike(r"^([a-zA-Z][a-zA-Z0-9+.-]*:)?//")
    return absolute & (registrable_domain(href) != registrable_domain(base))


def crawlable(link: Column) -> Column:
    """http or https and no file that holds no page."""
    return scheme(link).isin("http", "https") & ~F.lower(link).rlike(SKIPPED_FILES)
