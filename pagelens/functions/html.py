"""HTML expressions that need no tree: visible text, title, description, counters, links and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNSEEN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<noscript\b.*?</noscript>|<!--.*?-->"
TAG = r"<[^>]+>"
HREF = r"(?i)<a\b[^>]*\bhref=\"([^\"]*)\""
#: Substrings of a page that tell what made it; an argument of every function that uses it.
PLATFORMS = {"wordpress": ("wp-content", "wp-includes"), "drupal": ("drupal.js", "/sites/default/"), "shopify": ("cdn.shopify", ), "jquery": ("jquery",), "bootstrap": ("bootstrap",), "analytics": ("google-analytics", "gtag(", "track("), "example": (".example.", )}
MARKERS = {"cart": ("add-to-cart", "checkout", "basket"), "price": ("price", "€", "$"), "login": ("login", "sign-in", "password"), "copyright": ("&copy;", "©"), "ad": ("class=\"ad\"", "<!-- ad")}
COUNTED = ("p", "a", "h1", "h2", "h3", "li", "ul", "ol", "div", "img", "script", "style", "form", "input", "table", "article", "section", "nav", "footer", "br", "b", "iframe", "button", "video", "audio", "select", "textarea")


def visible_text(html: Column) -> Column:
    """Text outside tags, scripts, styles and comments, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(html, UNSEEN, " "), TAG, " ")
    return F.trim(F.regexp_replace(bare, r"[ \t\r\n\f]+", " "))


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def meta(html: Column, name: str) -> Column:
    return F.regexp_extract(html, rf"(?is)<meta[^>]*\b(?:name|property)=\"{name}\"[^>]*\bcontent=\"([^\"]*)\"", 1)


def tag_count(html: Column, tag: str) -> Column:
    return F.regexp_count(html, F.lit(rf"(?i)<{tag}[\s/>]"))


def counters(html: Column) -> list[Column]:
    """One column for each counted tag, and how much of the page is text."""
    made = [tag_count(html, t).alias(f"n_{t}") for t in COUNTED]
    return [*made, F.round(F.length(visible_text(html)) / F.greatest(F.length(html), F.lit(1)), 6).alias("text_ratio")]


#: Hosts whose links count as social.
SOCIAL = ("facebook.com", "twitter.com", "instagram.com", "linkedin.com", "youtube.com", "pinterest.com")


def more_counters(html: Column, social: tuple[str, ...] = SOCIAL) -> list[Column]:
    """Stylesheets, external scripts, social links, distinct tags, images to text, length of the description, link density."""
    text = F.greatest(F.length(visible_text(html)), F.lit(1))
    inside = F.aggregate(F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), F.lit(1)), F.lit(0), lambda n, x: n + F.length(F.trim(F.regexp_replace(x, TAG, ""))))
    return [
        F.regexp_count(html, F.lit(r"(?i)<link\b[^>]*\brel=[\"']?stylesheet")).alias("n_stylesheets"), F.regexp_count(html, F.lit(r"(?i)<script\b[^>]*\bsrc=")).alias("n_external_scripts"),
        F.size(F.filter(hrefs(html), lambda h: F.exists(F.array(*[F.lit(s) for s in social]), lambda s: F.contains(h, s)))).alias("n_social_links"), F.size(F.array_distinct(tags(html))).alias("n_unique_tags"),
        F.round(tag_count(html, "img") / text, 6).alias("image_text_ratio"), F.length(meta(html, "description")).alias("description_length"), F.round(inside / text, 6).alias("link_density"),
    ]


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(HREF), F.lit(1))


def matches(html: Column, needles: dict[str, tuple[str, ...]]) -> Column:
    """Names whose needles occur in the lower-case page, in order of ``needles``."""
    lower = F.lower(html)
    found = []
    for name, some in needles.items():
        hit = F.lit(False)
        for x in some:
            hit = hit | lower.contains(x)
        found.append(F.when(hit, F.lit(name)))
    return F.array_compact(F.array(*found))


def tags(html: Column) -> Column:
    """Names of all opening tags in order, outside comments."""
    return F.transform(F.regexp_extract_all(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1)), F.lower)


def strip_noise(html: Column) -> Column:
    """Without comments and without the bodies of scripts that hold no linked data; an open one runs to the end."""
    bare = F.regexp_replace(html, r"(?s)<!--.*?(-->|\Z)", "")
    return F.regexp_replace(bare, r"(?is)(<script\b(?![^>]*ld\+json)[^>]*>).*?(</script>|\Z)", "$1$2")
