"""Text expressions: normalising, scrubbing, tokens, labels, prompts and statistics, all as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
SPACE = r"[\s\x{A0}]+"
#: A few very frequent words of each language, for the vote of language_vote and as stop words.
FREQUENT = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "with", "are", "this", "be", "was", "on", "as"),
    "de": ("der", "die", "und", "das", "ist", "nicht", "ein", "eine", "von", "mit", "auf", "für", "den", "sich", "zu"),
    "fr": ("le", "la", "les", "des", "et", "est", "une", "que", "qui", "dans", "pour", "sur", "pas", "un", "avec"),
    "es": ("el", "los", "las", "que", "y", "en", "del", "por", "con", "para", "una", "se", "su", "no", "al"),
}
LETTERS = {"de": "äöüß", "fr": "éèêçà", "es": "ñíóáú", "cs": "ěščřžýůťď"}


def normalize(text: Column) -> Column:
    """Control characters and runs of white space become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, CONTROL, " "), SPACE, " "))


def straight_quotes(text: Column) -> Column:
    return F.translate(text, "“”„‘’", "\"\"\"''")


def drop_bad_references(text: Column) -> Column:
    """Remove character references that are not closed numbers."""
    return F.regexp_replace(text, r"&#\w*[^\d;]", "")


def unescape_common(text: Column) -> Column:
    """The five predefined entities and the no-break space; ampersands last."""
    for entity, character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


LETTERS_CS = "a-záčďéěíňóřšťúůýž"


def scrub(text: Column) -> Column:
    """Lower case without addresses, times, anything but letters and digits, and words of one or two letters."""
    text = F.lower(text)
    for pattern in (r"https?://[^ \t\n]+|www\.[^ \t\n]+", r"[^ \t\n]+@[^ \t\n]+\.[^ \t\n]+", r"[0-9]{1,2}:[0-9]{2}", r"[^\p{L}\p{N} ]+"):
        text = F.regexp_replace(text, pattern, " ")
    return F.trim(F.regexp_replace(F.array_join(F.filter(F.split(text, " "), lambda x: (F.length(x) > 2)), " "), " +", " "))


def scrub_web(text: Column, letters: str = LETTERS_CS, phrases: tuple[str, ...] = ("cookie", "cookies", "gdpr", "consent")) -> Column:
    """The scrub for page texts of one alphabet: lower case; without urls, mail addresses, no-break references, ``phrases``, clock times,
    what is neither letter, digit nor hyphen, and words of one or two letters."""
    steps = [r"https?://[^\s]+|www\.[^\s]+", r"[^\s]+@[^\s]+", "&nbsp;|&#160;"]
    steps += [rf"(?U)\b(?:{'|'.join(phrases)})\b"] if phrases else []
    steps += [r"(?U)\b[0-9]{1,2}:[0-9]{2}\b", rf"[^0-9{letters}\s-]", rf"(?U)\b[{letters}]{{1,2}}\b"]
    text = F.lower(text)
    for pattern in steps:
        text = F.regexp_replace(text, pattern, " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def scrub_plain(text: Column, letters: str = LETTERS_CS) -> Column:
    """The older scrub: as :func:`scrub_web` without phrases."""
    return scrub_web(text, letters, ())


def scrub_english(text: Column, stop: tuple[str, ...]) -> Column:
    """Words of three or more ASCII letters that are no stop words: digits, other characters and punctuation go, in this order, before words are cut."""
    text = F.regexp_replace(text, r"\s+", " ")
    for pattern in ("[0-9]", r"[^\x00-\x7F]", r"[!-/:-@\[-`{-~]"):
        text = F.regexp_replace(text, pattern, "")
    return F.array_join(F.filter(F.split(F.lower(text), " "), lambda w: (F.length(w) >= 3) & ~w.isin(*stop)), " ")


def clamp(n: int, most: int = 20_000) -> int:
    """A limit on input that must be positive and at most ``most``."""
    return most if n <= 0 else min(n, most)


def lemmatised(words: Column, table: dict[str, str] | None = None) -> Column:
    """Words by a lookup table; those it lacks stay. The table is the boundary to a lemmatiser that the caller brings."""
    if not table:
        return words
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(known, w), w))


def prepared(text: Column, stop: tuple[str, ...], table: dict[str, str] | None = None) -> Column:
    """The words of a text for a model: three or more letters, lemmatised, without stop words."""
    return F.filter(lemmatised(words(text, 3), table), lambda w: (F.length(w) >= 3) & ~w.isin(*stop))


def words(text: Column, least: int = 3) -> Column:
    """Runs of at least ``least`` letters, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"\p{{L}}{{{least},}}"), F.lit(0))


def content_words(text: Column, stop: tuple[str, ...]) -> Column:
    """Words that are not stop words; repeats stay."""
    return F.filter(words(text), lambda x: ~x.isin(*stop))


def truncated(text: Column, most: int) -> Column:
    """The first four fifths and the end of a text that is longer than ``most``, with a mark between."""
    head = most * 4 // 5
    cut = F.concat(F.rtrim(F.substring(text, 1, head)), F.lit("\n...[TRUNCATED]...\n"), F.ltrim(F.right(text, F.lit(most - head))))
    return F.when(F.length(text) > most, cut).otherwise(text)


def preview(text: Column, most: int = 200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def chunks(text: Column, number: int = 4, size: int = 1000) -> Column:
    """``number`` windows of ``size`` characters, evenly spread; a short text is one window."""
    step = (F.length(text) - size) / (number - 1)
    many = F.transform(F.sequence(F.lit(0), F.lit(number - 1)), lambda i: F.substring(text, F.floor(i * step).cast("int") + 1, F.lit(size)))
    return F.when(F.length(text) <= size, F.array(text)).otherwise(many)


def parse_labels(raw: Column) -> Column:
    """Labels of a JSON list or of a text divided by comma, semicolon or bar: trimmed, lower case, distinct, sorted."""
    listed = F.when(F.trim(raw).startswith("["), F.from_json(raw, "array<string>"))
    found = F.coalesce(listed, F.split(raw, "[,;|]"))
    return F.sort_array(F.array_distinct(F.filter(F.transform(found, lambda x: F.lower(F.trim(x))), lambda x: x.isNotNull() & (x != ""))))


def parse_label(raw: Column, known: tuple[str, ...]) -> Column:
    """The first label that is in ``known``, or null."""
    listed = F.when(F.trim(raw).startswith("["), F.from_json(raw, "array<string>"))
    found = F.transform(F.coalesce(listed, F.split(raw, "[,;|]")), lambda x: F.lower(F.trim(x)))
    return F.try_element_at(F.filter(found, lambda x: x.isin(*known)), F.lit(1))


def safe_label(label: Column) -> Column:
    return F.concat(F.lit("__label__"), F.regexp_replace(label, "[^0-9A-Za-z]+", "_"))


def plain_label(label: Column) -> Column:
    return F.replace(F.regexp_replace(label, "^__label__", ""), F.lit("_"), F.lit(" "))


def prompt(template: str, text: Column) -> Column:
    return F.replace(F.lit(template), F.lit("{text}"), text)


def json_answer(reply: Column) -> Column:
    """The JSON object in a reply: the whole, without a code fence, or from its first to its last brace; else null."""
    bare = F.trim(F.regexp_replace(F.trim(reply), r"^```[a-zA-Z]*\n|\n```$", ""))
    inner = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    whole = F.when(F.try_parse_json(bare).isNotNull() & bare.startswith("{"), bare)
    return F.coalesce(whole, F.when((inner != "") & F.try_parse_json(inner).isNotNull(), inner))


def keyword_share(text: Column, keywords: tuple[str, ...], of_keywords: bool = True) -> Column:
    """Percent of hits: of the number of keywords, or of the text's words (0 without words)."""
    size = F.lit(len(keywords)) if of_keywords else F.greatest(F.regexp_count(text, F.lit(r"\p{L}+")), F.lit(1))
    hits = F.size(F.filter(words(text, 1), lambda x: x.isin(*keywords)))
    return F.lit(100.0) * hits / size


def word_stats(text: Column) -> Column:
    """Number of words, their average length and the number of distinct ones."""
    found = words(text, 1)
    letters = F.aggregate(found, F.lit(0), lambda a, x: a + F.length(x))
    return F.struct(F.size(found).alias("n_words"), F.round(letters / F.greatest(F.size(found), F.lit(1)), 6).alias("avg_length"), F.size(F.array_distinct(found)).alias("n_distinct"))


def language_vote(text: Column) -> Column:
    """The language whose frequent words occur most, ties by name; null without any. One pass over the words."""
    langs = sorted(FREQUENT, reverse=True)
    start = F.struct(*[F.lit(0).alias(x) for x in langs])
    counts = F.aggregate(words(text, 1), start, lambda acc, w: F.struct(*[(acc[x] + w.isin(*FREQUENT[x]).cast("int")).alias(x) for x in langs]), lambda acc: F.array_max(F.array(*[F.struct(acc[x].alias("n"), F.lit(x).alias("lang")) for x in langs])))
    return F.when(counts["n"] > 0, counts["lang"])


def letter_share(text: Column, letters: str) -> Column:
    """The share of all letters that are among ``letters`` (0 without letters)."""
    return F.regexp_count(F.lower(text), F.lit(f"[{letters}]")) / F.greatest(F.regexp_count(text, F.lit(r"\p{L}")), F.lit(1))


def currency_mentions(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[$€£]|\b(?:EUR|USD|GBP|CZK|Kč)\b"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once; inside another function's lambda it would be computed again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def without_repeats(parts: Column, most: int = 3) -> Column:
    """The parts that occur at most ``most`` times. One sort of the parts, not a comparison of each with all."""

    def often(o: Column) -> Column:
        # a part that stands ``most`` places after an equal one in order occurs more often
        late = F.transform(F.sequence(F.lit(1), F.size(o)), lambda i: F.when((i > most) & (F.element_at(o, i) == F.element_at(o, F.greatest(i - most, F.lit(1)))), F.element_at(o, i)))
        return F.array_distinct(F.filter(late, lambda x: x.isNotNull()))

    def kept(p: Column) -> Column:
        return _let(F.array_sort(p), lambda o: _let(often(o), lambda f: F.when(F.size(f) == 0, p).otherwise(F.filter(p, lambda x: ~F.array_contains(f, x)))))

    return _let(parts, kept)


def without_repeated_lines(text: Column, most: int = 3) -> Column:
    """Lines that occur more than ``most`` times are removed altogether."""
    return F.array_join(without_repeats(F.split(text, "\n"), most), "\n")


def without_repeated_sentences(text: Column, most: int = 3) -> Column:
    """Parts between line ends, or between the end of a sentence and two blanks, that occur more than ``most`` times go; the rest is joined by blanks."""
    parts = F.filter(F.transform(F.split(text, r"[\n\r]+|(?<=[.!?])\s{2,}"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) == 0, text).otherwise(F.array_join(without_repeats(parts, most), " "))


def without_phrases(text: Column, patterns: tuple[str, ...]) -> Column:
    for p in patterns:
        text = F.regexp_replace(text, f"(?iu){p}", " ")
    return F.trim(F.regexp_replace(text, " +", " "))


def shape_stats(text: Column) -> Column:
    """Numbers that say what a text looks like in any script: shares of kinds of characters, word lengths, numbers."""
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda pattern: F.round(F.regexp_count(text, F.lit(pattern)) / n, 6)
    found = words(text, 1)
    return F.struct(
        share(r"\p{Lu}").alias("upper"), share(r"\p{Ll}").alias("lower"), share(r"\p{N}").alias("digit"), share(r"\p{P}").alias("punctuation"), share(r"\p{S}").alias("symbol"), share(r"\s").alias("space"),
        share(r"[^\x00-\x7F]").alias("beyond_ascii"), share("\n").alias("line"), F.regexp_count(text, F.lit(r"[0-9]{4}")).alias("n_years"), F.regexp_count(text, F.lit(r"[0-9]+[.,][0-9]{2}\b")).alias("n_prices"),
        F.size(F.filter(found, lambda w: F.length(w) >= 10)).alias("n_long"), F.size(F.filter(found, lambda w: F.length(w) <= 2)).alias("n_short"),
    )


def word_length_tokens(text: Column, most: int = 15) -> Column:
    """``n:wordlen=k`` for each length of words that occurs at least twice, longer ones counted as ``most``."""
    sizes = F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.least(F.length(w), F.lit(most)))
    kinds = _let(sizes, lambda z: F.filter(F.sequence(F.lit(1), F.lit(most)), lambda k: F.size(F.filter(z, lambda n: n == k)) >= 2))
    return F.transform(kinds, lambda k: F.concat(F.lit("n:wordlen="), k.cast("string")))


def language_tag(url: Column, text: Column, host: str = ".cz", lang: str = "cs", letters: str = "ěščřžýáíéúůďťň", other: str = "en", least: int = 200, share: float = 0.004) -> Column:
    """A language by host, else by the share of its own letters; short texts go by the url."""
    own = F.regexp_count(F.lower(text), F.lit(f"[{letters}]")) / F.greatest(F.regexp_count(text, F.lit(r"\p{L}")), F.lit(1))
    by_url = F.when(F.coalesce(url.contains(host), F.lit(False)), lang).otherwise(other)
    in_host = F.coalesce(F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.-]*:)?(?://)?([^/?#:]*)", 1).endswith(host), F.lit(False))
    return F.when(in_host, lang).when(F.regexp_count(text, F.lit(r"\p{L}")) < least, by_url).otherwise(F.when(own > share, lang).otherwise(other))
