"""Column functions over labels, definitions and codes. Nulls are treated as empty texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words that searches leave out.
STOPWORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might for of in on at to with "
    "by from that this these those and or but not if as it its any all each some such used use using also other than which when "
    "where who how what their they them there no so up out about into more can"
).split()

# Typographic characters and their plain forms.
TYPOGRAPHY = [
    ("–", "-"), ("—", "-"), ("‘", "'"), ("’", "'"), ("‚", ","), ("“", '"'), ("”", '"'), ("„", '"'),
    ("…", "..."), (" ", " "), ("­", ""), ("•", "*"), ("‹", "<"), ("›", ">"), ("«", "<"), ("»", ">"),
    ("≤", "<="), ("≥", ">="), (" ", " "), ("�", "-"),
]


def text_of(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def tokens(column: Column) -> Column:
    """Distinct words of two letters or more that aren't stop words, lower-cased."""
    found = F.regexp_extract_all(F.lower(text_of(column)), F.lit("[a-z]{2,}"), F.lit(0))
    return F.array_except(found, F.array(*map(F.lit, STOPWORDS)))


def overlap_score(query: Column, target: Column) -> Column:
    """Share of the query's tokens that the target has; 0 without tokens."""
    return F.when(F.size(query) > 0, F.size(F.array_intersect(query, target)) / F.size(query)).otherwise(F.lit(0.0))


def holds(text: Column, part: Column) -> Column:
    """Whether part is in text, ignoring case."""
    return F.contains(F.lower(text_of(text)), F.lower(text_of(part)))


def match_score(query_tokens: Column, query: Column, label: Column, definition: Column, label_tokens: Column, definition_tokens: Column) -> Column:
    """1 for the phrase itself in label or definition, else the better of 0.9 label and 0.5 definition overlap."""
    scattered = F.greatest(overlap_score(query_tokens, label_tokens) * 0.9, overlap_score(query_tokens, definition_tokens) * 0.5)
    return F.when(holds(label, query) | ((text_of(definition) != "") & holds(definition, query)), F.lit(1.0)).otherwise(scattered)


def is_verbatim(term: Column, description: Column, label: Column, definition: Column) -> Column:
    """Whether term, description or `term: description`, if over two characters, is in label and definition."""
    hay = F.concat_ws(" ", text_of(label), text_of(definition))
    t, d = F.trim(text_of(term)), F.trim(text_of(description))
    both = F.when(d != "", F.concat(t, F.lit(": "), d)).otherwise(F.lit(""))
    found = [(F.length(x) > 2) & holds(hay, x) for x in (t, d, both)]
    return found[0] | found[1] | found[2]


def query_entries(column: Column) -> Column:
    """The entries of a batch of queries, separated by semicolons and line feeds."""
    return F.filter(F.transform(F.split(text_of(column), r"[;\n]+"), lambda x: F.trim(x)), lambda x: x != "")


def query_term(entry: Column) -> Column:
    """The part before the first colon, if that isn't part of a URL; else the whole entry."""
    pair = F.regexp_extract(entry, r"(?s)^([^:/]{1,80}):\s*(.+)$", 1)
    return F.when(pair != "", F.trim(pair)).otherwise(entry)


def query_description(entry: Column) -> Column:
    found = F.trim(F.regexp_extract(entry, r"(?s)^([^:/]{1,80}):\s*(.+)$", 2))
    return F.when(found != "", found)


def normalize_text(column: Column) -> Column:
    """Typographic characters in their plain form."""
    out = column
    for mark, plain in TYPOGRAPHY:
        out = F.replace(out, F.lit(mark), F.lit(plain))
    return out


HIDDEN = ("script", "style", "svg", "symbol", "noscript")


def strip_tags(column: Column) -> Column:
    """Text without markup and without what isn't shown, trimmed."""
    out = column
    for tag in HIDDEN:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    return F.trim(F.regexp_replace(out, r"(?s)<[^>]+>", ""))


def is_curie(column: Column) -> Column:
    """prefix:local without a slash in it, and no scheme in place of the prefix."""
    prefix = F.substring_index(column, ":", 1)
    return F.contains(column, F.lit(":")) & (prefix != "") & ~F.contains(column, F.lit("/")) & ~prefix.isin("http", "https", "urn")


def capitalized(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1 << 20)))


def pascal_key(column: Column) -> Column:
    """A phrase as an identifier; a last word that is the initials of those before is left out, acronyms keep their case."""
    words = F.filter(F.split(column, "[^A-Za-z0-9]+"), lambda w: w != "")
    before = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
    initials = F.array_join(F.transform(before, lambda w: F.upper(F.substring(w, 1, 1))), "")
    used = F.when((F.size(words) >= 2) & (F.upper(F.element_at(words, -1)) == initials), before).otherwise(words)
    acronym = lambda w: (F.length(w) > 1) & (F.upper(w) == w) & F.rlike(w, F.lit("[A-Z]"))
    return F.array_join(F.transform(used, lambda w: F.when(acronym(w), w).otherwise(capitalized(w))), "")


def snake_case(column: Column) -> Column:
    """camelCase and PascalCase with underscores, lower-cased."""
    out = F.regexp_replace(column, "([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.lower(F.regexp_replace(out, "([a-z0-9])([A-Z])", "$1_$2"))


def clip_sentences(column: Column, n: int) -> Column:
    """The first n sentences; ` ...` where some were left out."""
    parts = F.split(column, r"(?<=[.!?])\s+")
    return F.when(F.size(parts) > n, F.concat(F.array_join(F.slice(parts, 1, n), " "), F.lit(" ..."))).otherwise(column)


def truncated(column: Column, n: int = 100) -> Column:
    return F.when(F.length(column) > n, F.concat(F.substring(column, 1, n), F.lit("..."))).otherwise(column)


def cell(column: Column) -> Column:
    """A text as a cell of a markdown table."""
    return F.replace(F.replace(text_of(column), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def bold_words(column: Column, words: list[str]) -> Column:
    """Whole words of the list in bold, ignoring case."""
    return F.regexp_replace(column, r"(?i)\b(" + "|".join(words) + r")\b", "**$1**") if words else column


def code_number(column: Column) -> Column:
    """The number of codes like 160b(i), for sorting."""
    return F.regexp_extract(column, r"^[A-Za-z]*([0-9]+)", 1).cast("int")


def code_letter(column: Column) -> Column:
    return F.lower(F.regexp_extract(column, r"^[A-Za-z]*[0-9]+([a-z]?)", 1))


def roman(column: Column) -> Column:
    """The value of the roman numeral, i to x, in the parentheses of a code; 0 without one."""
    numeral = F.lower(F.regexp_extract(column, r"\(([ivxIVX]+)\)", 1))
    return F.array_position(F.array(*map(F.lit, "i ii iii iv v vi vii viii ix x".split())), numeral).cast("int")


def dotted_key(column: Column) -> Column:
    """14.1.2 as the numbers 14, 1 and 2."""
    return F.transform(F.split(column, r"\."), lambda x: x.cast("int"))


def language_literal(column: Column) -> tuple[Column, Column]:
    """Text and language of `"text"@lang`."""
    return F.regexp_extract(column, r'^"(.*)"@([A-Za-z-]+)$', 1), F.regexp_extract(column, r'^"(.*)"@([A-Za-z-]+)$', 2)


def last_segment(column: Column) -> Column:
    """The part of a URI after its last slash."""
    return F.element_at(F.split(column, "/"), -1)


def source_key_of(column: Column) -> Column:
    """GeoNamesAdm1CA as GeoNames_ADM1_CA."""
    spaced = F.regexp_replace(column, r"^(GeoWiki|GeoNames)(Adm[0-9](?:Adm[0-9])?)([A-Z]{2})$", "$1_$2_$3")
    return F.concat(F.substring_index(spaced, "_", 1), F.upper(F.regexp_replace(spaced, r"^[A-Za-z]+", "")))


def camel_case(column: Column) -> Column:
    """A phrase with its first word in lower case and the others capitalized, without separators."""
    words = F.filter(F.split(column, "[^A-Za-z0-9]+"), lambda w: w != "")
    rest = F.array_join(F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), capitalized), "")
    return F.when(F.size(words) > 0, F.concat(F.lower(F.get(words, F.lit(0))), rest)).otherwise(F.lit(""))


def camel_to_title(column: Column) -> Column:
    """camelCase as words with capitals."""
    spaced = F.regexp_replace(column, "([a-z0-9])([A-Z])", "$1 $2")
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, 2, 1 << 20))


def class_name(column: Column) -> Column:
    """GeoWiki_ADM3ADM4_CA as GeoWikiAdm3Adm4CA: levels are capitalized, other parts keep their case but for the first letter."""
    part = lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 20))
    return F.regexp_replace(F.array_join(F.transform(F.split(column, "_"), part), ""), "ADM([0-9])", "Adm$1")


#: Words before which the head of a noun phrase ends.
PREPOSITIONS = ("of", "in", "for", "with", "under", "at", "on")


def plural(column: Column) -> Column:
    """A noun phrase in the plural: the word before the first preposition, or the last, changes."""
    words = F.split(column, " ")
    head = F.coalesce(F.nullif(F.array_position(F.transform(words, lambda w: w.isin(*PREPOSITIONS)), True), F.lit(0)) - 1, F.size(words).cast("long"))
    one = F.element_at(words, F.greatest(head, F.lit(1)).cast("int"))
    many = (
        F.when(F.rlike(one, F.lit("[^aeiou]y$")), F.concat(F.regexp_replace(one, "y$", ""), F.lit("ies")))
        .when(F.rlike(one, F.lit("(s|x|z|ch|sh)$")), F.concat(one, F.lit("es")))
        .otherwise(F.concat(one, F.lit("s")))
    )
    return F.array_join(F.transform(words, lambda w, i: F.when(i == F.greatest(head, F.lit(1)) - 1, many).otherwise(w)), " ")


def slug(column: Column) -> Column:
    """Lower-case words joined by hyphens."""
    return F.trim(F.regexp_replace(F.lower(column), "[^a-z0-9]+", "-"), F.lit("-"))


def sanitized_code(column: Column) -> Column:
    """A code in which all but letters, digits, dots and hyphens are one underscore, with none at the ends."""
    return F.trim(F.regexp_replace(column, r"[^A-Za-z0-9.\-]+", "_"), F.lit("_"))


def header_key(column: Column) -> Column:
    """Province/Territory as ProvinceTerritory."""
    words = F.filter(F.split(column, "[^A-Za-z0-9]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), "")


def code_range(column: Column) -> tuple[Column, Column, Column]:
    """Letters, start and stop of QA76-90 or QA76; start and stop are null without numbers."""
    part = lambda i: F.regexp_extract(column, r"^([A-Z]+)(?:([0-9]+(?:\.[0-9]+)?)(?:-([0-9]+(?:\.[0-9]+)?))?)?", i)
    start = F.nullif(part(2), F.lit("")).cast("double")
    return part(1), start, F.coalesce(F.nullif(part(3), F.lit("")).cast("double"), start)


def anchored(text: Column, anchor: Column, before: int = 200, size: int = 10_000) -> Column:
    """A window of the text from a little before the anchor on, ignoring case; from the start where the anchor isn't found."""
    at = F.greatest(F.instr(F.lower(text), F.lower(anchor)) - before, F.lit(1))
    return F.substring(text, at, F.lit(size))


def fragment(url: Column) -> Column:
    """What follows the # of a URL; empty without one."""
    return F.regexp_extract(url, "#(.*)$", 1)


def french_url(url: Column) -> Column:
    """The French page of an English one, by the language part of its path or name."""
    return F.regexp_replace(F.regexp_replace(url, "/en/", "/fr/"), r"-eng(\.[a-z]+)?($|\?)", "-fra$1$2")


def base_folder(url: Column) -> Column:
    """A URL up to its last slash."""
    return F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), "^(.*/)", 1)


def url_joined(base: Column, href: Column) -> Column:
    """A link of a page as a whole URL: absolute, from the host's root, or from the page's folder."""
    host = F.regexp_extract(base, r"^([a-z][a-z0-9+.\-]*://[^/?#]*)", 1)
    return F.when(F.rlike(href, F.lit(r"^[a-z][a-z0-9+.\-]*://")), href).when(F.startswith(href, F.lit("/")), F.concat(host, href)).otherwise(F.concat(base_folder(base), href))


def url_id(url: Column, name: str) -> Column:
    """The value of a parameter of a URL."""
    return F.nullif(F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1), F.lit(""))


def best_label(labels: Column, languages: list[str], *fields: Column) -> Column:
    """Of a map of labels by language that of the first language that has one, else the first field that isn't empty."""
    full = lambda x: F.nullif(F.trim(x), F.lit(""))
    return F.coalesce(*(full(F.try_element_at(labels, F.lit(x))) for x in languages), *map(full, fields))


def alpha2(column: Column) -> Column:
    """The country of a code like CA-ON; null where it isn't one."""
    return F.nullif(F.regexp_extract(column, "^([A-Z]{2})(?:-|$)", 1), F.lit(""))


def http_date(column: Column) -> Column:
    """The day of `Wed, 21 Oct 2015 07:28:00 GMT`; null for what isn't a date."""
    return F.try_to_timestamp(F.regexp_extract(column, r"^[A-Za-z]{3}, ([0-9]{2} [A-Za-z]{3} [0-9]{4} [0-9:]{8}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss")).cast("date")


def folded(column: Column) -> Column:
    """A sort key without accents and case."""
    plain = F.translate(F.lower(text_of(column)), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.regexp_replace(plain, "œ", "oe")


def any_of(queries: Column) -> Column:
    """Queries combined: one that looks for any of them."""
    return F.array_join(F.array_distinct(queries), " OR ")
