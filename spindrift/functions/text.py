"""Scalar functions over text, as Column expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def sorted_set(items: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(items, lambda x: x.isNotNull())))


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts, each framed by its length in bytes as eight bytes, lowest first."""
    framed = []
    for part in parts:
        raw = F.encode(part, "UTF-8")
        digits = F.lpad(F.hex(F.length(raw)), 16, "0")
        lowest_first = F.array_join(F.reverse(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.substr(digits, k * 2 + 1, F.lit(2)))), "")
        framed += [F.unhex(lowest_first), raw]
    return F.sha2(F.concat(*framed), 256)


URL_TRAILERS = r"""[.,;:)\]}"'>!?]+$"""
URL = r"^([A-Za-z]+)://([^/?#]+)([^#]*)"


def url_tokens(candidate: Column) -> Column:
    """url: and domain: tokens of an http address, else an empty array. Scheme and host are lower-cased, the
    fragment and closing slashes dropped."""
    scheme = F.lower(F.regexp_extract(candidate, URL, 1))
    host = F.lower(F.regexp_extract(candidate, URL, 2))
    address = F.regexp_replace(F.concat(scheme, F.lit("://"), host, F.regexp_extract(candidate, URL, 3)), "/+$", "")
    tokens = F.array(F.concat(F.lit("url:"), address), F.concat(F.lit("domain:"), F.regexp_replace(host, r"^www\.", "")))
    return F.when(scheme.isin("http", "https") & (host != ""), tokens).otherwise(F.array().cast("array<string>"))


CVE = r"(?<![0-9A-Za-z])([cC][vV][eE]-[0-9]{4,}-[0-9]{4,})"


def cves(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(CVE), F.lit(1)), lambda x: F.concat(F.lit("cve:"), F.upper(x)))


def derive_entities(title: Column, body: Column, links: Column) -> Column:
    """Entity tokens of an event: addresses among its links and words, and CVE numbers; sorted, distinct."""
    found = F.flatten(F.transform(F.coalesce(links, F.array().cast("array<string>")), url_tokens))
    for text in (title, F.coalesce(body, F.lit(""))):
        words = F.filter(F.split(text, r"\s+"), lambda w: F.contains(w, F.lit("://")))
        from_words = F.flatten(F.transform(words, lambda w: url_tokens(F.regexp_replace(w, URL_TRAILERS, ""))))
        found = F.concat(found, cves(text), from_words)
    return sorted_set(found)


def normalize_text(text: Column) -> Column:
    """Lower-cased letters and digits, one space between runs of them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def strip_article(text: Column) -> Column:
    return F.regexp_replace(text, "^the ", "")


def grounded_token(namespace: Column | str, name: Column, normalized_source: Column) -> Column:
    """namespace:slug if the name's words stand in the source, else null."""
    namespace = F.lit(namespace) if isinstance(namespace, str) else namespace
    core = strip_article(normalize_text(name))
    held = F.contains(F.concat(F.lit(" "), normalized_source, F.lit(" ")), F.concat(F.lit(" "), core, F.lit(" ")))
    return F.when((core != "") & held, F.concat(namespace, F.lit(":"), F.replace(core, F.lit(" "), F.lit("-"))))


def numeric_tokens(text: Column) -> Column:
    """Numbers, percentages, dates and times as they are written."""
    runs = F.regexp_extract_all(text, F.lit(r"[0-9%.,:/+-]+"), F.lit(0))
    with_digit = F.filter(runs, lambda t: t.rlike("[0-9]"))
    return F.transform(with_digit, lambda t: F.regexp_replace(t, r"^[.,:/+-]+|[.,:/+-]+$", ""))


def numbers_and_dates(text: Column) -> tuple[Column, Column]:
    tokens = numeric_tokens(text)
    is_date = lambda t: F.contains(t, F.lit("-")) | F.contains(t, F.lit(":"))
    return F.filter(tokens, lambda t: ~is_date(t)), F.filter(tokens, is_date)


def first_ungrounded_number(output: Column, ground: Column) -> Column:
    """The first number of the output that the ground doesn't have, or null."""
    have = numeric_tokens(ground)
    return F.get(F.filter(numeric_tokens(output), lambda t: ~F.array_contains(have, t)), F.lit(0))


#: Words that a summary must not use, in the order in which they are looked for. Fixed values.
BANNED = ("massive", "huge", "game-changing", "game changing", "exciting", "revolutionary", "you", "we", "your", "our")


def banned_word(text: Column) -> Column:
    """The first banned word that stands in the text as a whole word, '!' if there is none but that, or null."""
    low = F.lower(text)
    whole = lambda words: rf"(?<![\p{{L}}\p{{N}}])(?:{words})(?![\p{{L}}\p{{N}}])"
    first = F.lit(None).cast("string")
    for word in reversed(BANNED):
        first = F.when(low.rlike(whole(word)), F.lit(word)).otherwise(first)
    # one search tells most texts, which hold none, from those where the order matters
    return F.when(low.rlike(whole("|".join(BANNED))), first).when(F.contains(text, F.lit("!")), F.lit("!"))


LINKABLE = r"(?i)^(?:.*://.*|www\..*|mailto:.*|(?:[^/?#]*@)?(?:[a-z0-9-]+\.)+[a-z]{2,}(?::[^/?#]*)?(?:[/?#].*)?)$"


def core_token(word: Column) -> Column:
    return F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def first_linkable_token(text: Column) -> Column:
    """The first word, stripped of what surrounds it, that a reader's program would make a link of."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w.rlike(r"\.|:"))
    return F.get(F.filter(F.transform(words, core_token), lambda t: (t != "") & t.rlike(LINKABLE)), F.lit(0))


def defang(text: Column) -> Column:
    """The text with its linkable words made harmless; white space stays as it is."""
    parts = F.split(text, r"(?<=\s)(?=\S)|(?<=\S)(?=\s)")

    def safe(part: Column) -> Column:
        core = core_token(part)
        dull = F.replace(F.replace(core, F.lit("."), F.lit("[.]")), F.lit("://"), F.lit("[:]//"))
        dull = F.regexp_replace(dull, r"(?i)^(mailto):", "$1[:]")
        at = F.position(core, part)
        whole = F.concat(F.substring(part, F.lit(1), at - 1), dull, F.substring(part, at + F.length(core), F.length(part)))
        return F.when((core != "") & core.rlike(LINKABLE), whole).otherwise(part)

    return F.array_join(F.transform(parts, safe), "")


def truncate_words(text: Column, most: int) -> Column:
    """At most so many characters, cut at the last space among them if there is one."""
    head = F.substring(text, 1, most)
    cut = F.regexp_extract(head, r"(?s)^(.+) [^ ]*$", 1)
    return F.when(F.length(text) <= most, text).when(cut != "", cut).otherwise(head)


ENTITY = {"quot": '"', "#39": "'", "lt": "<", "gt": ">", "nbsp": " ", "amp": "&"}


def html_text(html: Column) -> Column:
    """The text of markup: scripts, styles and comments dropped, tags taken as spaces, white space and square
    brackets joined, and words made of '#' alone dropped. Null if nothing is left."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for name, char in ENTITY.items():
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    words = F.filter(F.split(text, r"[ \t\n\x0b\x0c\r\[\]]+"), lambda w: (w != "") & ~w.rlike("^#+$"))
    out = F.array_join(words, " ")
    return F.when(out != "", out)


def article_html(html: Column) -> Column:
    """The first article element, or the whole page."""
    found = F.regexp_extract(html, r"(?is)<article.*?</article>", 0)
    return F.when(found != "", found).otherwise(html)


def _body(node) -> str | None:
    """The first articleBody in a JSON value that isn't blank: an object's own, else that of the first of its
    values, in order of their keys, or of a list's items, that has one."""
    if isinstance(node, dict):
        own = node.get("articleBody")
        if isinstance(own, str) and own.strip():
            return own.strip()
        node = [node[k] for k in sorted(node)]
    return next((b for b in map(_body, node) if b), None) if isinstance(node, list) else None


def _no_number(name: str):
    raise ValueError(name)


def first_body(texts) -> str | None:
    """The article body of the first JSON text that has one; what isn't JSON, or is nested without end, has
    none."""
    for raw in () if texts is None else texts:
        try:
            found = _body(json.loads(raw, parse_constant=_no_number))
            if found and found.encode():
                return found
        except (ValueError, RecursionError):
            continue
    return None


def linked_article(html: Column) -> Column:
    """The article body of a page's linked data (JSON in scripts of that kind). JSON of any depth is searched
    in Arrow batches, as SQL has no recursion within a value; pages without such scripts send nulls."""
    scripts = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    search = F.pandas_udf(lambda found: found.map(first_body, na_action="ignore").astype(object), "string")
    return search(F.when(F.size(scripts) > 0, scripts))


def article_text(html: Column, most_markup: int | None = None, most: int | None = None) -> Column:
    """A page's article as text: the body that its linked data has, else its first article element, else the
    whole page; the first of these that leaves any text, of at most so many characters."""

    def text(markup: Column) -> Column:
        found = html_text(markup if most_markup is None else F.substring(markup, 1, most_markup))
        return found if most is None else truncate_words(found, most)

    return F.coalesce(text(linked_article(html)), text(article_html(html)), text(html))


def split_namespace(token: Column) -> tuple[Column, Column]:
    """Kind and value of a token; null without a colon."""
    has = F.contains(token, F.lit(":"))
    return F.when(has, F.substring_index(token, ":", 1)), F.when(has, F.regexp_extract(token, r"(?s)^[^:]*:(.*)$", 1))


def canonicalize(raw: Column) -> Column:
    kept = F.trim(raw)
    typed = kept.rlike("^[0-9A-Za-z]+:")
    return F.when(typed, F.concat(F.lower(F.substring_index(kept, ":", 1)), F.lit(":"), F.regexp_extract(kept, r"(?s)^[^:]*:(.*)$", 1))).otherwise(F.lower(kept))


def lexical_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of words if one has several, else Dice similarity of letter pairs as multisets."""
    words = lambda x: F.array_distinct(F.filter(F.split(x, "[ /_-]"), lambda w: w != ""))
    wa, wb = words(a), words(b)
    jaccard = F.size(F.array_intersect(wa, wb)) / F.greatest(F.size(F.array_union(wa, wb)), F.lit(1))
    pairs = lambda x: F.when(F.length(x) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substring(x, i, F.lit(2))))
    pa, pb = pairs(a), pairs(b)
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    shared = F.aggregate(F.array_distinct(pa), F.lit(0), lambda acc, x: acc + F.least(count(pa, x), count(pb, x)))
    dice = F.when((F.size(pa) == 0) | (F.size(pb) == 0), F.lit(0.0)).otherwise(2.0 * shared / (F.size(pa) + F.size(pb)))
    many = (F.size(wa) > 1) | (F.size(wb) > 1)
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).when(many, jaccard).otherwise(dice)


#: Kinds in the order in which they name a thread. Fixed values.
LABEL_ORDER = ("repo", "cve", "user", "domain", "url")


def auto_label(entities: Column) -> Column:
    """The foremost entity's value, and how many more there are; empty without entities."""
    order = F.create_map(*[F.lit(x) for k, v in enumerate(LABEL_ORDER) for x in (v, k)])
    ranked = F.array_sort(F.transform(entities, lambda e: F.struct(F.coalesce(F.try_element_at(order, F.substring_index(e, ":", 1)), F.lit(len(LABEL_ORDER))).alias("p"), e.alias("e"))))
    head = F.regexp_replace(F.get(ranked, F.lit(0))["e"], "(?s)^[^:]*:", "")
    more = F.size(entities) - 1
    return F.when(F.size(entities) > 0, F.when(more > 0, F.concat(head, F.lit(" +"), more.cast("string"))).otherwise(head)).otherwise("")


def auto_delta(n: Column) -> Column:
    return F.when(n == 1, F.lit("1 update")).when(n > 1, F.concat(n.cast("string"), F.lit(" updates")))


def clean(text: Column) -> Column:
    """Without control characters and the marks that reorder text."""
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f‎‏‪-‮⁦-⁩]", "")


def escape(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def safe_href(url: Column) -> Column:
    return F.when(F.lower(url).rlike("^https?://"), url)


def strip_reasoning(text: Column) -> Column:
    """What follows a model's closing think tag."""
    return F.trim(F.regexp_replace(text, "(?s)^.*</think>", ""))


def best_text(full_text: Column, body: Column) -> Column:
    return F.when(F.trim(full_text) != "", full_text).otherwise(body)


def faithful(headline: Column, tldr: Column, refs: Column, entities: Column, ground: Column) -> Column:
    """Why a summary may not be shown, the first reason in order, or null."""
    output = F.concat_ws(" ", headline, tldr)
    loose = F.get(F.filter(refs, lambda r: ~F.array_contains(entities, r)), F.lit(0))
    number, word, link = first_ungrounded_number(output, ground), banned_word(output), first_linkable_token(output)
    return (
        F.when((F.length(headline) > 90) | (F.length(tldr) > 480), F.lit("too_long"))
        .when(loose.isNotNull(), F.concat(F.lit("ungrounded_entity:"), loose))
        .when(number.isNotNull(), F.concat(F.lit("ungrounded_number:"), number))
        .when(word.isNotNull(), F.concat(F.lit("banned_word:"), word))
        .when(link.isNotNull(), F.concat(F.lit("url_in_prose:"), link))
    )
