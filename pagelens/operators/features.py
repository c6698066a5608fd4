"""What a page's tree says about it: token groups and statistics, both from one parse.

:class:`Page` sorts the elements of a tree by tag once; each group is a function of it that yields tokens, each
statistic a line of a table. Nothing is cut unless a limit is asked for.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import islice
from urllib.parse import SplitResult, urlsplit

from pagelens.functions import dom, urls

# The formats of tokens, the names of groups and statistics, and the following lists must be as
# they are for models and reports of other tools to read them.
GROUPS = ("tag", "attr", "href", "meta", "plat", "res", "css", "cssraw", "marker", "shape", "url", "words")
#: Substring of a lower-case page: what made or serves it.
PLATFORMS = {
    "wp-content": "wp", "wp-includes": "wp", "wp-json": "wp", "joomla": "joomla", "typo3": "typo3", "drupal": "drupal", "vbulletin": "vbulletin", "phpbb": "phpbb", "smf论坛": "smf", "oscommerce": "oscommerce",
    "magento": "magento", "prestashop": "prestashop", "woocommerce": "woocommerce", "shopify": "shopify", "zen-cart": "zencart", "heureka": "heureka", "googleapis": "googleapis", "google-analytics": "gapi",
    "googlesyndication": "gads", "doubleclick": "doubleclick", "adsense": "gads", "facebook": "facebook", "twitter": "twitter", "youtube": "youtube", "vimeo": "vimeo", "dailymotion": "dailymotion", "flash": "flash",
    "jquery": "jquery", "bootstrap": "bootstrap", "extjs": "extjs", "paypal": "paypal", "google.com/maps": "gmaps", "openstreetmap": "osm", "disqus": "disqus", "hotjar": "hotjar", "scorecardresearch": "comscore",
    "sessiontracker": "sessiontracker", "gemius": "gemius", "piwik": "piwik", "matomo": "matomo", "gravatar": "gravatar", "cloudflare": "cloudflare", "fonts.googleapis": "gfonts", "typekit": "typekit",
    "recaptcha": "recaptcha", "stripe.com": "stripe", "braintree": "braintree", "mailchimp": "mailchimp", "feedburner": "feedburner", "rss": "rss", "atom.xml": "atom", "twitter.com/intent": "tw_intent", "plusone": "gplus",
    "sharethis": "sharethis", "addthis": "addthis", "printfriendly": "printfriendly", "addtoany": "addtoany", "akismet": "wp", "cdn.": "cdn",
}
#: Substrings of a lower-case page that tell what it is for.
MARKERS = {
    "age_gate": ("age verification", "age-gate", "agegate", "18+ only", "vetujem"),
    "cart": ("add to cart", "add-to-cart", "addtocart", "do kosiku", "kosik", "shopping cart", "cart_item", "basket"),
    "price": ("price:", "cena:", 'class="price', 'itemprop="price', "product-price"),
    "recipe": ("ingredients", "prísady", "prisady", "postup", "instructions:", "nutritional", "serving size"),
    "reviews": ("review", "hodnoceni", "hodnocení", "rating", "stars", "zaznamek"),
    "specs": ("specification", "technicke parametry", "technické parametry", "parameters", "kapacita", "rozmery"),
    "score_table": ("plused", "minused", "vs.", "zapas", "zápas", "result"),
    "forum": ("reply", "odpoved", "odpověď", "thread", "topic", "diskuse", "príspevok"),
    "job": ("salary", "plat:", "nabidka prace", "nabídka práce", "curriculum"),
    "events": ("event", "udalost", "událost", "calendar", "kalendar", "vstupenky", "ticket"),
}
FRAME_SITES = ("youtube", "google", "facebook", "twitter", "vimeo", "map")
LOGIN_NAMES, NEWS_NAMES, SEARCH_NAMES = ("login", "prihl", "signin", "auth"), ("newsletter", "zasylka", "subscribe", "news"), ("search", "hledav", "hledaj")
# End of fixed values.

HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
SILENT = ("script", "style")
_NAME = re.compile("[a-z0-9]+")
_NUMBER_SEGMENT = re.compile(r"/[0-9]{1,8}(?:[./]|$)")
_EXTENSION = re.compile(r"\.([A-Za-z0-9]{1,5})(?:[?#]|$)")
_LD_TYPE = re.compile(r'"@type"\s*:\s*"([A-Za-z]{2,30})"')
_LETTERS = re.compile(r"[^\W\d_]{3,}")


def name_tokens(name: str, most: int = 40) -> list[str]:
    """Alphanumeric parts of more than two characters that are no numbers, and all of them joined by hyphens."""
    parts = [x for x in _NAME.findall(name.strip()[:most].lower()) if len(x) > 2 and not x.isdigit()]
    joined = "-".join(parts)
    return parts + [joined] * (len(parts) > 1 and len(joined) <= most)


def split(url: str) -> SplitResult:
    """A url's parts; one without a scheme starts with its host. What no url is has none."""
    try:
        return urlsplit(url if "://" in url or url.startswith("//") else f"//{url}")
    except ValueError:
        return SplitResult("", "", "", "", "")


def host(parts: SplitResult) -> str:
    try:
        return (parts.hostname or "").lower()
    except ValueError:
        return ""


def host_tokens(url: str) -> list[str]:
    return [t for label in host(split(url)).split(".") if label not in urls.STOP_LABELS for t in name_tokens(label)]


def path_tokens(url: str) -> list[str]:
    segments = [s for s in split(url).path.split("/") if s]
    return [t for s in segments[:-1] for t in name_tokens(s.rpartition(".")[0] or s)]


def file_tokens(url: str) -> list[str]:
    """Name tokens of the last segment's stem, and ``ext:`` of its extension; nothing without a dot."""
    stem, _, extension = split(url).path.rstrip("/").rpartition("/")[2].rpartition(".")
    return name_tokens(stem) + [f"ext:{extension.lower()}"] * (0 < len(extension) <= 5) if stem else []


def href_shape(href: str) -> list[str]:
    """How a link is written, never what its words mean."""
    if not href:
        return []
    out, query = [], href.partition("?")[2]
    if found := _EXTENSION.search(href):
        out.append(f"H:ext={found[1].lower()}")
    if query:
        pairs = query.split("&")
        keys = (p.partition("=")[0].lower() for p in pairs[:6])
        out += [f"H:q={min(len(pairs), 6)}", *(f"H:key={k}" for k in keys if len(k) <= 16)]
    flags = {"frag": "#" in href, "numseg": _NUMBER_SEGMENT.search(href), "slash": href.endswith("/"), "mailto": href.startswith("mailto:"), "jscript": href.startswith("javascript:"), "template": re.search(r"[{}]|%d", href)}
    out += [f"H:{name}" for name, on in flags.items() if on]
    depth = sum(1 for s in href.partition("?")[0].split("/") if s) - 2
    return [*out, f"H:depth={min(max(depth, 0), 8)}"]


def number(text: str) -> float:
    try:
        return float(re.sub(r"[^0-9.]", "", text) or 0)
    except ValueError:
        return 0.0


class Page:
    """The elements of a page by tag, and what several groups need of them."""

    def __init__(self, nodes: list[dom.Node], html: str, url: str | None = None):
        self.nodes, self.html, self.lower = nodes, html, html.lower()
        self.host = host(split(url)) if url else ""
        self.by: dict[str, list[dom.Node]] = defaultdict(list)
        for n in nodes:
            self.by[n.tag].append(n)
        self.counts = {t: len(some) for t, some in self.by.items()}
        self.total = len(nodes)

    def values(self, tag: str, attribute: str) -> list[str]:
        """The non-empty values of an attribute of all elements of a tag."""
        return [v for n in self.by.get(tag, ()) if (v := n.attrs.get(attribute))]

    def having(self, attribute: str) -> list[str]:
        return [v for n in self.nodes if (v := n.attrs.get(attribute))]

    def n(self, *tags: str) -> int:
        return sum(self.counts.get(t, 0) for t in tags)

    @cached_property
    def text(self) -> str:
        """All text outside scripts and styles, white space as it is."""
        return " ".join(x for n in self.nodes if n.tag not in SILENT for x in n.parts if isinstance(x, str))

    @cached_property
    def classes(self) -> list[list[str]]:
        """Of each element with classes, those that look like names."""
        return [[c for c in v.split() if len(c) <= 30] for v in self.having("class")]

    @cached_property
    def ids(self) -> Counter:
        return Counter(self.having("id"))

    @cached_property
    def platforms(self) -> list[str]:
        return [needle for needle in PLATFORMS if needle in self.lower]

    @cached_property
    def markers(self) -> list[str]:
        return [name for name, needles in MARKERS.items() if any(x in self.lower for x in needles)]

    @cached_property
    def schema_types(self) -> list[tuple[str, str]]:
        """Where a type is declared (schema or ld) and its name."""
        micro = [("schema", x.rpartition("/")[2]) for v in self.having("itemtype") for x in v.split() if "schema.org/" in x]
        return micro + [("ld", t) for body in self.linked_data for t in _LD_TYPE.findall(body)]

    @cached_property
    def linked_data(self) -> list[str]:
        kinds = ("application/ld+json", "application/json+ld")
        return [body(n) for n in self.by.get("script", ()) if n.attrs.get("type", "").lower() in kinds]

    @cached_property
    def metas(self) -> list[tuple[str, str, str]]:
        """Name, property and content of each meta element, the first two in lower case."""
        return [(n.attrs.get("name", "").lower(), n.attrs.get("property", "").lower(), n.attrs.get("content", "")) for n in self.by.get("meta", ())]

    @cached_property
    def shapes(self) -> list[str]:
        return [t for h in self.values("a", "href") for t in href_shape(h)]

    @cached_property
    def runs(self) -> list[tuple[str, str, int]]:
        return dom.runs(self.nodes)

    @cached_property
    def paragraphs(self) -> list[int]:
        """The words of each paragraph."""
        return [len(n.text().split()) for n in self.by.get("p", ())]

    @cached_property
    def anchors(self) -> list[str]:
        return [n.text() for n in self.by.get("a", ())]

    @cached_property
    def forms(self) -> list[tuple[str, str]]:
        """Of each form its action and its names (class and id), in lower case."""
        return [(n.attrs.get("action", "").lower(), f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}".lower()) for n in self.by.get("form", ())]

    @cached_property
    def letters(self) -> dict[str, int]:
        """How many characters of each kind the text has; one pass over its distinct characters."""
        out: Counter = Counter()
        for c, n in Counter(self.text).items():
            low = c.lower()
            out["upper"] += n * c.isupper()
            out["letter"] += n * c.isalpha()
            out["digit"] += n * c.isdigit()
            out["space"] += n * (c == " ")
            out["punct"] += n * unicodedata.category(c).startswith("P")
            out["nonlatin"] += n * (ord(c) > 0x2100 and not c.isspace())
            out["curly_quote"] += n * (c in "“”")
            out["guillemet"] += n * (c in "«»")
            out["dashes"] += n * (c in "–—")
            out["diacritic"] += n * (low.isalpha() and unicodedata.normalize("NFD", low)[:1] != low)
        return dict(out)

    @cached_property
    def numbers(self) -> dict[str, int]:
        return {"decimal": len(re.findall(r"[0-9]+\s*[.,]\s*[0-9]+", self.text)), "thousands": len(re.findall(r"[0-9]{1,3}(?:[\s.][0-9]{3})+", self.text)), "percent": self.text.count("%")}


def body(node: dom.Node) -> str:
    return "".join(x for x in node.parts if isinstance(x, str))


def tag_tokens(p: Page) -> Iterator[str]:
    for n in p.nodes:
        yield f"t:{n.tag}"
        yield f"p:{n.parent.tag if n.parent else '#doc'}>{n.tag}"
        yield f"d:{n.tag}@{min(n.depth, 8)}"
    yield from (f"T:{t}" for t, _ in Counter(p.counts).most_common(12))
    yield f"X:uniq_tags={min(len(p.counts), 40)}"
    yield f"X:depth={min(max(n.depth for n in p.nodes), 18)}"
    yield from (f"R:{tag}>{kids or 'text'}" for (tag, kids), _ in Counter((tag, kids) for tag, kids, _ in p.runs).most_common(4))


def attr_tokens(p: Page) -> Iterator[str]:
    for n in p.nodes:
        yield from (f"a:{n.tag}[{k}]" for k in sorted(n.attrs))
    yield from (f"a:rel={v.lower()[:30]}" for v in p.values("a", "rel"))
    yield from ("a:target" for _ in p.values("a", "target"))
    for n in p.by.get("img", ()):
        wide, high = number(n.attrs.get("width", "")), number(n.attrs.get("height", ""))
        if wide and high:
            yield from ["img:wide"] * (wide / high > 2.2) + ["img:tall"] * (wide / high < 0.45) + ["img:icon"] * (max(wide, high) <= 32)
    yield from (f"x:td={min(sum(c.tag in ('td', 'th') for c in n.children), 12)}" for n in p.by.get("tr", ()))
    yield from (f"x:input_type={(n.attrs.get('type') or 'text').lower()}" for n in p.by.get("input", ()))
    for tags, token in (((h,), f"h:{h}") for h in HEADINGS):
        yield from [token] * p.n(*tags)
    yield from ["x:frames"] * p.n("frame", "frameset") + ["x:font_tag"] * p.n("font") + ["x:flash"] * ("flash" in p.lower) + ["x:frameset_raw"] * ("<frameset" in p.lower)


def meta_tokens(p: Page) -> Iterator[str]:
    for name, prop, content in p.metas:
        yield from [f"m:meta={name[:24]}"] * bool(name) + [f"m:og={prop[:28]}"] * bool(prop)
        if "generator" in name:
            yield f"m:generator={'_'.join(name_tokens(content)[:3])}"
    yield from (f"m:http_equiv={v.lower()[:18]}" for v in p.values("meta", "http-equiv"))
    yield from (f"m:itemprop={x.lower()[:24]}" for v in p.values("meta", "itemprop") for x in v.split())
    for n in p.by.get("link", ()):
        rels, kind = n.attrs.get("rel", "").lower(), n.attrs.get("type", "").lower()
        for rel in rels.split():
            yield f"m:link_rel={rel[:24]}"
            if "alternate" in rel:
                yield f"m:alt_type={kind[-16:] or 'none'}"
        if "alternate" in rels and n.attrs.get("hreflang"):
            yield "m:hreflang"
    yield from (f"m:form_action={':'.join(name_tokens(action)[:3]) or 'none'}" for action, _ in p.forms)
    for code in (body(n) for n in p.by.get("script", ()) if not n.attrs.get("src")):
        yield from ["m:js_datalayer"] * ("JSON.parse" in code or "dataLayer" in code) + ["m:jsonld"] * bool(re.search(r"\{\s*[\"']?@type", code))
    yield from (f"s:{where}_{t.lower()[:26]}" for where, t in p.schema_types)


def plat_tokens(p: Page) -> Iterator[str]:
    yield from (f"P:{PLATFORMS[needle]}" for needle in p.platforms)
    yield from (f"P:script_{t}" for src in p.values("script", "src") for t in host_tokens(src))
    yield from (f"P:iframe_{site}" for src in p.values("iframe", "src") for site in FRAME_SITES if site in src)
    yield from ("P:datauri" for src in p.values("img", "src") if src.startswith("data:"))
    yield from (f"r:{t}" for href in p.values("a", "href") for t in file_tokens(href) if t.startswith("ext:"))


def res_tokens(p: Page) -> Iterator[str]:
    for tag, attribute in (("a", "href"), ("img", "src"), ("script", "src"), ("link", "href")):
        yield from (f"r:{t}" for v in p.values(tag, attribute) for t in file_tokens(v) if tag != "a" or not t.startswith("ext:"))


def css_tokens(p: Page) -> Iterator[str]:
    yield from (f"c:{t}" for some in p.classes for c in some for t in name_tokens(c))
    yield from (f"i:{t}" for v in p.having("id") for t in name_tokens(v))
    for action, names in p.forms:
        yield from (f"fa:{t}" for t in name_tokens(action)[:3])
        yield from ["fa:search"] * ("search" in names or any(x in action for x in SEARCH_NAMES))
    for name in p.values("input", "name"):
        yield from (f"in:{t}" for t in name_tokens(name)[:3])
        yield from ["in:search"] * ("search" in name.lower())


def cssraw_tokens(p: Page) -> Iterator[str]:
    yield from ("C:" + "-|-".join(some[:3]) for some in p.classes if len(some) > 1)
    names = dict.fromkeys(c for some in p.classes for c in some)
    if len(names) > 1:
        yield from (f"C:{c.lower()[:24]}" for c in islice(names, 200))
        yield from ["X:duplicate_ids"] * any(n > 1 for n in p.ids.values())


def shape_tokens(p: Page) -> Iterator[str]:
    size = max(1, len(p.text))
    yield from (f"n:wordlen={n}" for n, k in Counter(min(len(w), 15) for w in p.text.split()).items() if k >= 2)
    yield from (f"n:cc={kind}={int(min(9, 40 * k / size))}" for kind, k in p.letters.items() if k > 0.002 * size)
    yield from ["n:numberish"] * bool(p.numbers["decimal"]) + ["n:thousands_sep"] * bool(p.numbers["thousands"])


def url_tokens(p: Page) -> Iterator[str]:
    for tag, attribute, cut, prefix in (("a", "href", path_tokens, "u"), ("a", "href", host_tokens, "uh"), ("img", "src", path_tokens, "u"), ("script", "src", host_tokens, "uh")):
        yield from (f"{prefix}:{t}" for v in p.values(tag, attribute) for t in cut(v))


TOKENS: dict[str, Callable[[Page], Iterator[str]]] = {
    "tag": tag_tokens, "attr": attr_tokens, "href": lambda p: iter(p.shapes), "meta": meta_tokens, "plat": plat_tokens, "res": res_tokens, "css": css_tokens, "cssraw": cssraw_tokens,
    "marker": lambda p: (f"M:{m}" for m in p.markers), "shape": shape_tokens, "url": url_tokens, "words": lambda p: iter(_LETTERS.findall(p.text.lower())),
}


def share(a: float, b: float) -> float:
    return a / max(1, b)


def _links(p: Page) -> dict[str, float]:
    hrefs, anchors = p.values("a", "href"), p.by.get("a", ())
    site = ".".join(p.host.split(".")[-2:])
    hosts = [host(urlsplit(h)) if "//" in h and split(h).netloc else "" for h in hrefs]
    away = [h for h in hosts if h and site and ".".join(h.split(".")[-2:]) != site]
    words = sorted(len(a.split()) for a in p.anchors)
    leading = sum(len(n.parts[0].split()) for n in anchors if n.parts and isinstance(n.parts[0], str))
    seen, before = 0, None
    long = iter(p.paragraphs)
    for n in p.nodes:
        seen += n.tag == "a"
        if n.tag == "p" and next(long) >= 40 and before is None:
            before = seen
    return {
        "link_text_ratio": share(leading, sum(p.paragraphs)), "n_external_domains": math.log1p(len(set(away))), "external_link_share": share(len(away), len(hrefs)),
        "avg_path_depth": share(sum(h.count("/") - 2 * h.startswith("http") for h in hrefs), len(hrefs)), "query_link_share": share(sum("?" in h for h in hrefs), len(hrefs)),
        "anchor_words_p50": float(words[len(words) // 2]) if words else 0.0, "anchor_numeric_share": share(sum(any(c.isdigit() for c in a) for a in p.anchors), len(anchors)),
        "anchor_empty_share": share(sum(not a for a in p.anchors), len(anchors)), "anchor_imgonly_share": share(sum(bool(a) and any(c.tag == "img" for c in n.children) for a, n in zip(p.anchors, anchors)), len(anchors)),
        "anchor_title_share": share(len(p.values("a", "title")), len(anchors)), "href_keys": float(len({t for t in p.shapes if t.startswith("H:key=")})), "content_start_ratio": share(seen if before is None else before, len(anchors)),
    }


def _tree(p: Page) -> dict[str, float]:
    depths, kids = sorted(n.depth for n in p.nodes), [len(n.children) for n in p.nodes]
    lists = [len(n.children) for t in ("ul", "ol", "dl") for n in p.by.get(t, ())]
    shares = [n / p.total for n in p.counts.values()]
    repeated = [n for _, _, n in p.runs]
    return {
        "html_bytes": math.log1p(len(p.html.encode())), "n_elements": math.log1p(p.total), "n_nodes": math.log1p(p.total + p.html.count("<!--")), "n_comment_el": math.log1p(p.html.count("<!--")),
        "depth_max": float(depths[-1]), "depth_mean": sum(depths) / p.total, "depth_p90": float(depths[int(0.9 * (p.total - 1))]), "children_mean": sum(kids) / p.total, "children_max": float(max(kids)),
        "n_unique_tags": float(len(p.counts)), "tag_entropy": -sum(x * math.log2(x) for x in shares), "tag_top1_share": max(shares), "leaf_ratio": sum(not n.children and not body(n).strip() for n in p.nodes) / p.total,
        "li_per_list": share(sum(lists), len(lists)), "max_table_cols": float(max((sum(c.tag in ("td", "th") for c in n.children) for n in p.by.get("tr", ())), default=0)), "tr_per_table": share(p.n("tr"), p.n("table")),
        "repeat_runs": float(len(repeated)), "repeat_biggest": float(max(repeated, default=0)), "repeat_ratio": share(sum(repeated), sum(kids)),
    }


def _texts(p: Page) -> dict[str, float]:
    size, words = len(p.text), sum(p.paragraphs)
    n_words, kinds = max(1, len(p.text.split())), p.letters
    of = lambda kind, n: share(kinds.get(kind, 0), n)
    return {
        "n_text_chars": math.log1p(size), "n_words": math.log1p(words), "text_per_element": size / p.total, "text_per_node": size / (p.total + p.html.count("<!--")), "avg_words_per_p": share(words, len(p.paragraphs)),
        "sh_text_chars": float(size), "sh_n_words": float(n_words), "sh_avg_word_len": of("letter", n_words), "sh_digit_ratio": of("digit", size), "sh_punct_ratio": of("punct", size), "sh_space_ratio": of("space", size),
        "sh_upper_ratio": of("upper", kinds.get("letter", 0)), "sh_diacritic_ratio": of("diacritic", size), "sh_nonlatin_ratio": of("nonlatin", size), "sh_decimal_number_density": p.numbers["decimal"] / n_words,
        "sh_thousands_sep_density": p.numbers["thousands"] / n_words, "sh_percent_density": p.numbers["percent"] / n_words, "sh_letters_per_element": kinds.get("letter", 0) / p.total,
    }


def _styles(p: Page) -> dict[str, float]:
    styles, named = p.having("style"), sum(map(len, p.classes))
    return {
        "css_rules": math.log1p(sum(body(n).count("{") for n in p.by.get("style", ()))), "style_attr_share": len(styles) / p.total, "n_inline_color": math.log1p(sum("color" in s for s in styles)),
        "n_bg_image": math.log1p(sum("background-image" in s or "url(" in s for s in styles)), "n_font_size_small": math.log1p(sum("font-size" in s and ("px" in s or "pt" in s) for s in styles)),
        "n_classes_unique": math.log1p(len({c for some in p.classes for c in some})), "n_class_per_element": named / p.total, "n_ids": math.log1p(len(p.ids)), "unique_id_ratio": share(len(p.ids), sum(p.ids.values())),
    }


def _head(p: Page) -> dict[str, float]:
    links = [(n.attrs.get("rel", "").lower(), n.attrs.get("type", "").lower()) for n in p.by.get("link", ())]
    fields = {name or prop: content for name, prop, content in reversed(p.metas)}
    title, about = next((n.text() for n in p.by.get("title", ())), ""), fields.get("description", "").strip()
    root = p.nodes[0].attrs
    flags = {
        "has_lang": "lang" in root or "xml:lang" in root, "has_charset": bool(p.values("meta", "charset")) or any("charset" in content.lower() for _, _, content in p.metas), "has_viewport": any(name == "viewport" for name, _, _ in p.metas),
        "has_canonical": any("canonical" in rel for rel, _ in links), "has_og": any(prop.startswith(("og:", "twitter:", "fb:")) for _, prop, _ in p.metas), "has_twitter": "twitter:" in p.lower or "twitter.com" in p.lower,
        "has_microdata": bool(p.having("itemprop") or p.values("meta", "itemtype")), "has_jsonld": bool(p.linked_data), "has_rdf": "xmlns:rdf" in p.lower or "rdf:rdf" in p.lower, "has_frameset": "<frameset" in p.lower,
        "n_meta_desc": bool(about), "has_price_marker": "price" in p.markers, "has_cart_marker": "cart" in p.markers,
    }
    return {k: float(v) for k, v in flags.items()} | {
        "title_len": float(len(title)), "meta_desc_len": float(len(about)), "meta_kw_n": float(sum(1 for k in fields.get("keywords", "").split(",") if k.strip())), "n_head_link": math.log1p(len(links)),
        "n_css_link": math.log1p(sum("stylesheet" in rel.split() for rel, _ in links)), "n_rss_link": float(sum("alternate" in rel and any(x in kind for x in ("rss", "atom", "xml")) for rel, kind in links)),
        "n_schema_types": float(len({t for _, t in p.schema_types})), "n_platforms": float(len(p.platforms)), "n_raw_markers": float(len(p.markers)),
    }


def _forms(p: Page) -> dict[str, float]:
    kinds = Counter((n.attrs.get("type") or "text").lower() for n in p.by.get("input", ()))
    methods = Counter((n.attrs.get("method") or "get").lower() for n in p.by.get("form", ()))
    asks = lambda names: float(any(x in action or x in own for action, own in p.forms for x in names))
    return {
        **{f"n_input_{k}": float(kinds[k]) for k in ("hidden", "submit", "text", "checkbox")}, "n_input_search": float(any("search" in k for k in kinds)),
        "n_forms_get": float(methods["get"]), "n_forms_post": float(methods["post"]), "has_login_form": asks(LOGIN_NAMES), "has_newsletter": asks(NEWS_NAMES),
    }


#: Statistics that are the logarithm of how often tags occur.
COUNTED = {
    "n_links": ("a",), "n_img": ("img",), "n_table": ("table",), "n_tr": ("tr",), "n_form": ("form",), "n_input": ("input",), "n_select": ("select",), "n_textarea": ("textarea",), "n_button": ("button",), "n_script": ("script",),
    "n_style_el": ("style",), "n_meta": ("meta",), "n_iframes": ("iframe",), "n_embed": ("embed",), "n_video": ("video",), "n_audio": ("audio",), "n_object": ("object",), "n_br": ("br",), "n_hr": ("hr",), "n_p": ("p",),
    "n_li": ("li",), "n_dl": ("dl",), "n_heading": HEADINGS, "n_div": ("div",), "n_bold": ("b", "strong", "em", "i"), "n_small": ("small",), "n_pre": ("pre",), "n_blockquote": ("blockquote",),
}
#: Statistics that are the share of tags among all elements.
SHARED = {"link_per_element": ("a",), "a_share": ("a",), "table_per_element": ("table",), "p_per_element": ("p",), "heading_per_element": HEADINGS, "div_share": ("div",), "span_share": ("span",)}


def statistics(p: Page) -> dict[str, float]:
    """All numbers about one page."""
    out = {name: math.log1p(p.n(*tags)) for name, tags in COUNTED.items()} | {name: p.n(*tags) / p.total for name, tags in SHARED.items()}
    images = p.by.get("img", ())
    out |= {
        "n_h1": float(p.n("h1")), "n_ext_script": math.log1p(len(p.values("script", "src"))), "img_per_link": share(len(images), p.n("a")), "img_alt_share": share(len(p.values("img", "alt")), len(images)),
        "img_with_dims_share": share(sum(bool(n.attrs.get("width") and n.attrs.get("height")) for n in images), len(images)),
    }
    for part in (_tree, _texts, _links, _styles, _head, _forms):
        out |= part(p)
    return out


STATISTICS = tuple(sorted(statistics(Page(dom.parse("<p>a</p>"), "<p>a</p>"))))
