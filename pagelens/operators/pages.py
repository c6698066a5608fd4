"""Relations over page trees: the node table, token groups, dense statistics and text renderings.

The tree is built once for each page, in Arrow batches; everything that can be said over the node table
is a DataFrame operation on it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions import dom, text
from pagelens.operators import features
from pagelens.sources import codec

NODES = "page_id long, pos int, depth int, parent_pos int, tag string, parent_tag string, n_children int, text_length int, n_words int"
FEATURES = "page_id long, tokens array<struct<grp:string,token:string,tf:int>>, stats array<double>"
#: ARIA landmark and window roles, and what HTML calls the parts around the content; parts of other words are left out.
BOILERPLATE = ("banner", "complementary", "contentinfo", "navigation", "alertdialog", "dialog", "menu", "toolbar", "tooltip", "header", "footer", "aside")
GROUPS, DENSE_NAMES = features.GROUPS, features.STATISTICS


#: Pages whose rows leave Python together, so that a worker stays small.
PAGES = 64


def _frames(f: Callable[[int, list[dom.Node], str], Iterator[tuple]], columns: list[str], most: int | None = None):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for start in range(0, len(part), PAGES):
                some = part.iloc[start : start + PAGES]
                out: list[tuple] = []
                for page_id, page in zip(some["page_id"], some["html"]):
                    nodes = dom.parse(page, most)
                    if nodes:
                        out.extend(f(page_id, nodes, page))
                yield pd.DataFrame(out, columns=columns)

    return run


def node_table(pages: DataFrame) -> DataFrame:
    """``(page_id, html)`` to one row for each element in document order; unparseable pages have none.

    ``text_length`` is of the element's own text, ``n_words`` of all text in a paragraph (0 for other elements).
    """

    def rows(page_id, nodes, page):
        for n in nodes:
            own = sum(len(x) for x in n.parts if isinstance(x, str))
            words = len(n.text().split()) if n.tag == "p" else 0
            yield page_id, n.position, n.depth, n.parent.position if n.parent else -1, n.tag, n.parent.tag if n.parent else None, len(n.children), own, words

    columns = [c.split()[0] for c in NODES.split(", ")]
    codec.small_batches()
    found = pages.select("page_id", "html").mapInPandas(_frames(rows, columns), NODES)
    return found.withColumn("parent_pos", F.when(F.col("parent_pos") >= 0, F.col("parent_pos")))


def depth_stats(nodes: DataFrame) -> DataFrame:
    """Depth and children by page; percentiles are the discrete element, not interpolated."""
    depths = F.sort_array(F.collect_list("depth"))
    return nodes.groupBy("page_id").agg(
        F.count("*").alias("n_nodes"), F.max("depth").alias("max_depth"), F.round(F.avg("depth"), 6).alias("avg_depth"),
        F.element_at(depths, (F.floor(F.lit(0.9) * (F.size(depths) - 1)) + 1).cast("int")).alias("p90_depth"), F.max("n_children").alias("max_children"), F.countDistinct("tag").alias("n_tags"),
    )


def repeat_runs(nodes: DataFrame) -> DataFrame:
    """``page_id, parent_pos, signature, n``: at least three siblings with one tag and one list of children's tags."""
    kids = nodes.groupBy("page_id", F.col("parent_pos").alias("pos")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tag"))), lambda x: x["tag"]), "+").alias("kids"))
    signed = nodes.join(kids, ["page_id", "pos"], "left").withColumn("signature", F.concat("tag", F.lit("("), F.substring(F.coalesce("kids", F.lit("")), 1, 40), F.lit(")")))
    return signed.where("parent_pos is not null").groupBy("page_id", "parent_pos", "signature").agg(F.count("*").alias("n")).where("n >= 3")


def top_tags(nodes: DataFrame, k: int = 12) -> DataFrame:
    """The ``k`` most frequent tags of each page, ties by first place."""
    counts = nodes.groupBy("page_id", "tag").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    w = Window.partitionBy("page_id").orderBy(F.desc("n"), "first")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("first")


def links_before_text(nodes: DataFrame, least: int = 40) -> DataFrame:
    """How many links come before the first paragraph with ``least`` words."""
    w = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = nodes.withColumn("links", F.sum((F.col("tag") == "a").cast("int")).over(w))
    return run.where((F.col("tag") == "p") & (F.col("n_words") >= least)).groupBy("page_id").agg(F.min_by("links", "pos").alias("links_before"))


def page_features(pages: DataFrame, groups: tuple[str, ...] = GROUPS, stats: bool = True, most: int | None = None) -> DataFrame:
    """``page_id, tokens, stats``: all counted tokens of the groups and the numbers named by ``DENSE_NAMES``, from one parse of each page.

    ``pages`` has ``page_id``, ``html`` and, for external links, ``url``. Pages without a tree have no row.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for start in range(0, len(part), PAGES):
                out = []
                for row in part.iloc[start : start + PAGES].itertuples(index=False):
                    nodes = dom.parse(row.html, most)
                    if nodes:
                        p = features.Page(nodes, row.html, row.url)
                        tokens = [{"grp": g, "token": t, "tf": min(n, 32767)} for g in groups for t, n in Counter(features.TOKENS[g](p)).items()]
                        found = features.statistics(p) if stats else {}
                        out.append((row.page_id, tokens, [round(found[k], 9) for k in DENSE_NAMES] if stats else None))
                yield pd.DataFrame(out, columns=["page_id", "tokens", "stats"])

    codec.small_batches()
    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")
    return pages.select("page_id", "html", url.alias("url")).mapInPandas(run, FEATURES)


def token_rows(made: DataFrame) -> DataFrame:
    """``page_id, grp, token, tf`` of the features."""
    return made.select("page_id", F.inline("tokens"))


def stat_columns(made: DataFrame) -> DataFrame:
    """``page_id`` and one double for each of ``DENSE_NAMES``."""
    return made.select("page_id", *[F.element_at("stats", i + 1).alias(k) for i, k in enumerate(DENSE_NAMES)])


def token_groups(pages: DataFrame, groups: tuple[str, ...] = GROUPS) -> DataFrame:
    return token_rows(page_features(pages, groups, stats=False))


def dense_stats(pages: DataFrame) -> DataFrame:
    return stat_columns(page_features(pages, groups=()))


def renderings(pages: DataFrame, words: tuple[str, ...] = BOILERPLATE) -> DataFrame:
    """``page_id, title, description, keywords, og_title, og_description, headings, body, main, lines`` of each page."""

    def rows(page_id, nodes, page):
        f = dom.heading_fields(nodes)
        yield page_id, f["title"], f["description"], f["keywords"], f["og_title"], f["og_description"], f["headings"], f["body"], dom.main_content(nodes, words), dom.markdownish(nodes)

    names = ["page_id", "title", "description", "keywords", "og_title", "og_description", "headings", "body", "main", "lines"]
    kinds = ["long", *["string"] * 5, "array<string>", *["string"] * 3]
    codec.small_batches()
    return pages.select("page_id", "html").mapInPandas(_frames(rows, names), ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def weighted_text(weights: dict[str, int], body: int = 4000) -> Column:
    """One text of a rendering for a classifier: fields repeated by weight, then the body's beginning."""
    parts = [F.repeat(F.concat(F.col(k), F.lit(" ")), w) for k, w in weights.items() if k != "headings"]
    headings = F.repeat(F.concat(F.array_join("headings", " "), F.lit(" ")), weights.get("headings", 0))
    return F.trim(F.regexp_replace(F.concat(*parts, headings, F.substring("body", 1, body)), r"\s+", " "))


def cleaned_plain(stop: tuple[str, ...] = ()) -> Column:
    """The older cleaned text of a rendering: title three times, description and headings twice, the body, scrubbed."""
    parts = F.concat_ws(" ", *["title"] * 3, *["description"] * 2, *[F.array_join("headings", " ")] * 2, "body")
    return _without(text.scrub_plain(parts), stop)


def cleaned(phrases: tuple[str, ...] = (), stop: tuple[str, ...] = (), most: int = 3) -> Column:
    """The cleaned text of a rendering: title, description, keywords, og description, headings and main text once each; repeated parts and phrases go, the rest is scrubbed."""
    parts = F.concat_ws("\n", "title", "description", "keywords", "og_description", F.array_join("headings", "\n"), "main")
    return _without(text.scrub_web(text.without_phrases(text.without_repeated_sentences(parts, most), phrases)), stop)


def _without(column: Column, stop: tuple[str, ...]) -> Column:
    return F.array_join(F.filter(F.split(column, " "), lambda w: ~w.isin(*stop)), " ") if stop else column


def encoder_text(most: int = 8000) -> Column:
    """One text of a rendering for an encoder: title, first description, visible text."""
    first = F.coalesce(*[F.when(F.col(c) != "", F.substring(c, 1, 300)) for c in ("description", "og_description", "keywords")], F.lit(""))
    return F.substring(F.trim(F.regexp_replace(F.concat_ws(" ", "title", first, "body"), r"\s+", " ")), 1, most)
