"""What a model reads of a page: its cleaned text, identifiers and candidate descriptions, as expressions over its outline.

A page is parsed once (`outline`): its text is numbered pieces, its elements are intervals of pieces. Stripping is a list of intervals that are hidden, the text
of an element is what is left in its interval, and a selector is a test on a tag and attributes. All of it is array functions, row by row.

The functions here compose SQL text, so that a plan of some thousand nodes is one parse and not as many calls into the JVM.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelathe.functions.coerce import Field
from pagelathe.functions.text import CITATION, END_HEADINGS, PHONETIC
from pagelathe.operators.outline import outlined

# Results must equal those of other readers of the same pages.
BOILERPLATE = (
    ("ol", "class", "references"), ("div", "class", "reflist"), ("div", "class", "refbegin"), ("span", "class", "mw-editsection"),
    ("sup", "class", "reference"), ("table", "class", "navbox"),
)
HEADING_IDS = ("References", "External_links", "Further_reading", "See_also", "Notes", "Bibliography", "Citations", "Footnotes", "Sources", "Works_cited")
HOST_RULES = (
    (("sec.gov",), (("table", "class", "tableFile"), ("table", "class", "tableFile2"), ("div", "class", "formGrouping"), ("div", "id", "secNav"), ("div", "id", "globalNav"))),
    (
        ("courtlistener.com", "justia.com", "law.cornell.edu"),
        (("div", "class", "footnote"), ("div", "class", "footnotes"), ("a", "class", "footnote-link"), ("sup", "class", "footnote"), ("nav", "class", "breadcrumb"), ("aside", "class", "sidebar")),
    ),
    (
        ("readthedocs.io", "readthedocs.org", "gitbook.io", "docusaurus.io"),
        (("nav", "class", "sidebar"), ("aside", "class", "toc"), ("div", "class", "toc"), ("footer", "class", "docs-footer"), ("div", "class", "edit-this-page"), ("div", "class", "page-nav")),
    ),
    (
        ("twitter.com", "x.com", "instagram.com", "linkedin.com", "reddit.com"),
        (("div", "role", "dialog"), ("div", "class", "login-overlay"), ("div", "data-testid", "login-prompt"), ("section", "aria-label", "Suggested")),
    ),
)
SENSITIVE = re.compile(r"signatur|exhibit|footnote|\bnote\b|\btoc\b|table[\s_]of[\s_]contents", re.I)
PRODUCT_FIELD = re.compile(r"\b(price|stock|sku|availability|in_stock|inventory|product)\b", re.I)
#: (attribute, how, value): `word` is one of the attribute's words, `part` lies in it, `any` is its presence.
PRODUCT_BLOCKS = (
    ("class", "word", "product_main"), ("class", "word", "product_page"), ("class", "word", "product"), ("class", "word", "product-main"),
    ("class", "word", "product-detail"), ("itemtype", "part", "Product"), ("data-product", "any", ""),
)
LIST_BLOCKS = (
    ("class", "word", "quote"), ("tag", "word", "article"), ("itemscope", "any", ""), ("class", "part", "item"), ("class", "part", "card"),
    ("class", "part", "entry"), ("class", "part", "post"), ("class", "li", ""),
)
LIST_LIMIT, LIST_CHARS, LIST_KEY = 80, (15, 2000), 200
DESCRIPTION_FIELDS = ("description", "summary", "tagline", "bio", "about", "headline", "subtitle")
BYLINE = r"(?i)\b(author|byline|hnuser|creator|byline-name|post-author|entry-author|article-author|author-name|author-link|post-meta)\b"
STATS = r"(?i)\b(score|points?|votes?|upvotes?|downvotes?|likes?|views?|karma|reactions?|shares?|favorites?)\b"
#: White space, that of other scripts too.
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"


Text = str  # of an SQL expression
_names = itertools.count()


def lit(value: str | int) -> Text:
    return str(value) if isinstance(value, int) else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def of(function: str, array: Text, use: Callable[..., Text], index: bool = False) -> Text:
    """function(array, x -> use(x)), or (x, i) -> use(x, i)."""
    k = next(_names)
    x, i = f"x{k}", f"i{k}"
    return f"{function}({array}, ({x}, {i}) -> {use(x, i)})" if index else f"{function}({array}, {x} -> {use(x)})"


def each(array: Text, use: Callable[[Text], Text]) -> Text:
    return of("transform", array, use)


def only(array: Text, use: Callable[[Text], Text]) -> Text:
    return of("filter", array, use)


def some(array: Text, use: Callable[[Text], Text]) -> Text:
    return of("exists", array, use)


def let(value: Text, use: Callable[[Text], Text]) -> Text:
    """use(value), with value computed once however often it is used."""
    return f"get({each(f'array({value})', use)}, 0)"


def strip(c: Text) -> Text:
    return f"regexp_replace({c}, {lit(f'^{SPACE}+|{SPACE}+$')}, '')"


def squeeze(c: Text) -> Text:
    return f"trim(regexp_replace({c}, {lit(f'{SPACE}+')}, ' '))"


def plain(c: Text) -> Text:
    """Without footnote marks and pronunciations, runs of blanks made single."""
    return f"trim(regexp_replace(regexp_replace(regexp_replace({c}, {lit(CITATION)}, ''), {lit(PHONETIC)}, ''), '  +', ' '))"


def short(c: Text, most: int) -> Text:
    return let(f"trim({c})", lambda t: f"if(length({t}) > {most}, concat(rtrim(left({t}, {most})), '…'), {t})")


def attr(e: Text, name: str) -> Text:
    return f"try_element_at({e}.attrs, {lit(name)})"


def words(e: Text, name: str) -> Text:
    return f"{e}.classes" if name == "class" else f"split(coalesce({attr(e, name)}, ''), {lit(f'{SPACE}+')})"


def matches(e: Text, rules: tuple) -> Text:
    """Whether an element has the tag and the attribute's value of one of the rules; a class is one of its words, or all of it."""
    test = lambda a, v: f"(coalesce({attr(e, a)} = {lit(v)}, false)" + (f" or array_contains({words(e, a)}, {lit(v)}))" if a == "class" else ")")
    return "(" + " or ".join(f"({e}.tag = {lit(tag)} and {test(a, v)})" for tag, a, v in rules) + ")"


def tagged(e: Text, *tags: str) -> Text:
    return f"{e}.tag in ({', '.join(map(lit, tags))})"


def part(array: Text, begin: Text, end: Text) -> Text:
    """Elements of an array from `begin` (0 is the first) up to `end`."""
    return f"slice({array}, {begin} + 1, greatest({end} - {begin}, 0))"


def intervals(elements: Text, test: Callable[[Text], Text]) -> Text:
    return each(only(elements, test), lambda e: f"struct({e}.begin as a, {e}.stop as z)")


def within(i: Text, found: Text) -> Text:
    """Whether piece i lies in one of the intervals."""
    return some(found, lambda h: f"{h}.a <= {i} and {i} < {h}.z")


def inside(e: Text, elements: Text) -> Text:
    return part(elements, f"({e}.number + 1)", f"({e}.last + 1)")


def first(elements: Text, test: Callable[[Text], Text]) -> Text:
    return f"get({only(elements, test)}, 0)"


def first_tag(elements: Text, tag: str) -> Text:
    return first(elements, lambda e: tagged(e, tag))


def shown(pieces: Text, hidden: Text) -> Text:
    """The text of each piece, null where an interval of `hidden` has it."""
    return let(hidden, lambda h: of("transform", pieces, lambda p, i: f"if({within(i, h)}, null, {p}.text)", index=True))


def strings(texts: Text, e: Text) -> Text:
    """The stripped pieces of an element that are not hidden."""
    return only(each(part(texts, f"{e}.begin", f"{e}.stop"), strip), lambda x: f"{x} != ''")


def block_lines(pieces: Text, texts: Text, begin: Text, end: Text) -> Text:
    """The text of an interval, a line for each block; a hidden piece still ends a line."""
    marked = f"zip_with({part(pieces, begin, end)}, {part(texts, begin, end)}, (p, t) -> concat(if(p.fresh, '\\n', ''), coalesce(translate(t, '\\r\\n', '  '), '')))"
    return only(each(f"split(array_join({marked}, ''), '\\n')", squeeze), lambda x: f"{x} != ''")


def whole_text(pieces: Text, e: Text) -> Text:
    """The text of an element as one string; what is hidden elsewhere counts too. Null for no element."""
    return let(e, lambda x: f"if({x} is null, null, array_join({each(part(pieces, f'{x}.begin', f'{x}.stop'), lambda p: strip(f'{p}.text'))}, ''))")


def unseen(elements: Text) -> Text:
    return intervals(elements, lambda e: tagged(e, "script", "style", "noscript"))


def boilerplate(elements: Text) -> Text:
    """Intervals of reference lists, edit links, phonetic spans, and of what follows a heading of a closing section."""
    phonetic = lambda e: f"({tagged(e, 'span')} and {some(words(e, 'class'), lambda w: f'{w} rlike ' + lit(chr(92) + 'bIPA' + chr(92) + 'b'))})"
    own = intervals(elements, lambda e: f"{matches(e, BOILERPLATE)} or {phonetic(e)}")
    titles = only(elements, lambda e: f"coalesce({attr(e, 'id')} in ({', '.join(map(lit, HEADING_IDS))}), false)")
    around = lambda e: only(elements, lambda x: f"{tagged(x, 'h1', 'h2', 'h3', 'h4')} and {x}.number < {e}.number and {e}.number <= {x}.last")
    ends = only(each(titles, lambda e: f"try_element_at({around(e)}, -1)"), lambda h: f"{h} is not null")
    # a heading's own number and its parent's say what comes after it on its level
    after = let(ends, lambda hs: intervals(elements, lambda e: f"size({hs}) > 0 and {some(hs, lambda h: f'{e}.number >= {h}.number and {e}.up = {h}.up')}"))
    return f"concat({own}, {after})"


def host_furniture(elements: Text, url: Text) -> Text:
    """Intervals of page furniture of hosts that are known, by the end of the address's authority."""
    authority = f"lower(regexp_extract(coalesce({url}, ''), {lit('^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)')}, 1))"
    none = intervals(elements, lambda e: "false")
    on = lambda host, suffixes: " or ".join(f"endswith({host}, {lit(s)})" for s in suffixes)
    cases = lambda host: " ".join(f"when {on(host, suffixes)} then {intervals(elements, fits(rules))}" for suffixes, rules in HOST_RULES)
    return let(authority, lambda host: f"case {cases(host)} else {none} end")


def fits(rules: tuple) -> Callable[[Text], Text]:
    return lambda e: matches(e, rules)


def keeps_sections(fields: list[Field]) -> bool:
    """Whether a field asks for a section that host rules would take away."""
    return any(SENSITIVE.search(f"{f.name}\n{f.hint or ''}") for f in fields)


def chosen(elements: Text, texts: Text, rules: tuple) -> Text:
    """Elements by selector that have something to see, the selectors in order, each element once."""

    def test(e: Text, name: str, how: str, value: str) -> Text:
        if name == "tag":
            return tagged(e, value)
        if how == "li":
            return f"{tagged(e, 'li')} and {attr(e, name)} is not null"
        if how == "any":
            return f"{attr(e, name)} is not null"
        return f"array_contains({words(e, name)}, {lit(value)})" if how == "word" else f"contains({attr(e, name)}, {lit(value)})"

    rank = lambda e: "case " + " ".join(f"when {test(e, *rule)} then {k}" for k, rule in enumerate(rules)) + " end"
    ranked = each(elements, lambda e: f"struct({rank(e)} as rank, {e}.number as number, {e}.begin as begin, {e}.stop as stop)")
    seen = lambda x: f"({x}.begin = {x}.stop or {some(part(texts, f'{x}.begin', f'{x}.stop'), lambda t: f'{t} is not null')})"
    return f"array_sort({only(ranked, lambda x: f'{x}.rank is not null and {seen(x)}')})"


def product_block(elements: Text, texts: Text) -> Text:
    """The text of product details, which a main text often lacks."""
    found = each(chosen(elements, texts, PRODUCT_BLOCKS), lambda e: f"array_join({strings(texts, e)}, '\\n')")
    return f"array_join({only(found, lambda t: f'length({t}) > 20')}, '\\n\\n')"


def once(rows: Text, key: Callable[[Text], Text]) -> Text:
    """rows without those whose key an earlier one has."""
    return let(rows, lambda xs: let(each(xs, key), lambda ks: of("filter", xs, lambda x, i: f"array_position({ks}, {key(x)}) = {i} + 1", index=True)))


def list_block(elements: Text, texts: Text, limit: int = LIST_LIMIT) -> Text:
    """The text of repeated cards and items, each beginning once, `limit` at most."""
    found = each(chosen(elements, texts, LIST_BLOCKS), lambda e: f"array_join({strings(texts, e)}, ' ')")
    fit = only(found, lambda t: f"length({t}) between {LIST_CHARS[0]} and {LIST_CHARS[1]}")
    return f"array_join(slice({once(fit, lambda t: f'left({t}, {LIST_KEY})')}, 1, {limit}), '\\n\\n')"


def scored_text(pieces: Text, texts: Text, elements: Text) -> Text:
    """Lines that are content by their number of words and share of linked words, and those of their neighbours.

    The decision tree over shallow text features of Kohlschütter, Fankhauser and Nejdl (2010), with lines for blocks.
    """
    links = intervals(elements, lambda e: f"{tagged(e, 'a')} and {attr(e, 'href')} is not null")
    count = lambda c: f"size({only(f'split({c}, {lit(chr(32))})', lambda w: f'{w} != {lit(str())}')})"
    # a linked piece is written between two marks, so that a line knows how much of it is linked
    marked = let(links, lambda ls: of("transform", texts, lambda t, i: f"if({within(i, ls)}, concat('\x01', {t}, '\x02'), {t})", index=True))

    def line(x: Text) -> Text:
        linked = f"array_join(regexp_extract_all({x}, '\x01([^\x01\x02]*)\x02', 1), ' ')"
        return let(squeeze(f"translate({x}, '\x01\x02', '')"), lambda t: f"struct({t} as text, {count(t)} as n, {count(squeeze(linked))} as linked)")

    blocks = only(each(block_lines(pieces, marked, "0", f"size({pieces})"), line), lambda x: f"{x}.text != ''")
    share = lambda b: f"if({b}.n > 0, {b}.linked / {b}.n, 0D)"

    def content(x: Text, before: Text, after: Text) -> Text:
        beside_text = f"({x}.n > 16 or {after}.n > 15 or {before}.n > 4)"
        beside_links = f"({x}.n > 40 or {after}.n > 17)"
        return f"{share(x)} <= 0.333333D and if({share(before)} <= 0.555556D, {beside_text}, {beside_links})"

    at = lambda bs, i: f"coalesce(get({bs}, {i}), named_struct('text', '', 'n', 0, 'linked', 0))"
    good = lambda bs: of("filter", bs, lambda x, i: let(at(bs, f"{i} - 1"), lambda before: let(at(bs, f"{i} + 1"), lambda after: content(x, before, after))), index=True)
    return let(blocks, lambda bs: f"array_join({each(good(bs), lambda x: f'{x}.text')}, '\\n')")


def main_text(pieces: Text, texts: Text, elements: Text) -> Text:
    """The article or main part if it has over 50 characters, else what is scored as content, else the page; the last two without navigation."""
    long = lambda c: let(c, lambda t: f"if(length({t}) > 50, {t}, null)")
    joined = lambda lines: f"array_join({lines}, '\\n')"
    own = lambda tag: let(first_tag(elements, tag), lambda e: f"if({e} is null, null, {joined(block_lines(pieces, texts, f'{e}.begin', f'{e}.stop'))})")
    furniture = intervals(elements, lambda e: tagged(e, "nav", "footer", "header", "aside", "head"))
    bare = let(furniture, lambda h: of("transform", texts, lambda t, i: f"if({within(i, h)}, null, {t})", index=True))
    rest = let(bare, lambda ts: f"coalesce({long(scored_text(pieces, ts, elements))}, {joined(block_lines(pieces, ts, '0', f'size({pieces})'))})")
    return f"coalesce({long(own('article'))}, {long(own('main'))}, {rest})"


def until_end_heading(c: Text) -> Text:
    """The lines before the first that is an end heading, with a colon or without."""
    ends = f"({', '.join(map(lit, END_HEADINGS))})"
    at = lambda lines: f"array_position({each(lines, lambda x: f'lower(regexp_replace(trim({x}), {lit(chr(58) + chr(43) + chr(36))}, {lit(str())})) in {ends}')}, true)"
    return let(f"split({c}, '\\n')", lambda lines: let(at(lines), lambda k: f"rtrim(array_join(if({k} > 0, slice({lines}, 1, cast({k} - 1 as int)), {lines}), '\\n'))"))


def cleaned(page: Text, url: Text, fields: list[Field]) -> Column:
    """The text that a model reads: product details and cards if the fields want them, then the main text."""
    pieces, elements = f"{page}.pieces", f"{page}.elements"
    hidden = [unseen(elements), boilerplate(elements)]
    if not keeps_sections(fields):
        hidden.append(host_furniture(elements, url))

    def made(texts: Text) -> Text:
        parts = [main_text(pieces, texts, elements)]
        if any(f.type.startswith("array<") for f in fields):
            parts.insert(0, list_block(elements, texts))
        if any(PRODUCT_FIELD.search(f.name) for f in fields):
            parts.insert(0, product_block(elements, texts))
        return f"array_join({only(f'array({", ".join(parts)})', lambda p: f'{p} != {lit(str())}')}, '\\n\\n')"

    return F.expr(plain(until_end_heading(let(shown(pieces, f"concat({', '.join(hidden)})"), made))))


def meta(metas: Text, *names: str) -> Text:
    """The content of the first meta element with one of the names, the names in order; null if blank or missing."""
    one = lambda a, n: f"nullif({strip(attr(first(metas, lambda e: f'coalesce({attr(e, a)} = {lit(n)}, false)'), 'content'))}, '')"
    return "coalesce(" + ", ".join(one(a, n) for n in names for a in ("name", "property", "itemprop")) + ")"


def metas_of(page: Text) -> Text:
    return only(f"{page}.elements", lambda e: tagged(e, "meta"))


def linked(page: Text) -> Text:
    return only(f"{page}.facts", lambda f: f"{f}.source = 'json-ld'")


def from_linked_data(facts: Text, *keys: str) -> Text:
    """The first text under one of the keys, object by object."""
    names = f"array({', '.join(map(lit, keys))})"
    found = only(facts, lambda f: f"array_contains({names}, {f}.key) and {strip(f'{f}.value')} != '' and not startswith({f}.value, '[') and not startswith({f}.value, '{{')")
    hits = each(found, lambda f: f"struct({f}.item as item, array_position({names}, {f}.key) as key, {strip(f'{f}.value')} as value)")
    return f"get(array_sort({hits}), 0).value"


def named(facts: Text) -> Text:
    """The author of linked data: a text, the name of an object, or that of the first of a list, object by object."""
    names = "array('author', 'author.name', 'creator', 'creator.name')"
    value = lambda v: strip(f"if(startswith({v}, '['), coalesce(get(from_json({v}, 'array<string>'), 0), {v}), {v})")
    hits = each(only(facts, lambda f: f"array_contains({names}, {f}.key)"), lambda f: f"struct({f}.item as item, array_position({names}, {f}.key) as key, {value(f'{f}.value')} as value)")
    return f"get(array_sort({only(hits, lambda h: f'{h}.value != {lit(str())}')}), 0).value"


def author_text(page: Text, metas: Text, data: Text) -> Text:
    elements, pieces = f"{page}.elements", f"{page}.pieces"
    brief = lambda test: let(whole_text(pieces, first(elements, test)), lambda t: f"if(length({t}) between 1 and 99, {t}, null)")
    handle = let(strip(f"ltrim('@', {meta(metas, 'twitter:creator')})"), lambda t: f"if(length({t}) > 2, {t}, null)")
    ways = (
        meta(metas, "author", "article:author"),
        handle,
        named(data),
        brief(lambda e: f"{tagged(e, 'a')} and array_contains({words(e, 'rel')}, 'author')"),
        brief(lambda e: f"coalesce({attr(e, 'class')} rlike {lit(BYLINE)}, false)"),
        brief(lambda e: tagged(e, "address")),
    )
    return f"coalesce({', '.join(ways)})"


def author(page: Text) -> Column:
    """The author by declared metadata, then by mark-up: the first of these that says something."""
    return F.expr(let(metas_of(page), lambda m: let(linked(page), lambda d: author_text(page, m, d))))


def stats(page: Text) -> Text:
    """Short texts with a digit of the first eight elements that are classed as counts."""
    found = f"slice({only(f'{page}.elements', lambda e: f'coalesce({attr(e, str('class'))} rlike {lit(STATS)}, false)')}, 1, 8)"
    texts = each(found, lambda e: whole_text(f"{page}.pieces", e))
    return f"array_distinct({only(texts, lambda t: f'length({t}) between 2 and 79 and {t} rlike {lit("[0-9]")}')})"


def identifiers(page: Text, url: Text) -> Column:
    """What says which page this is, a line each, for what the main text may lack; empty if nothing does."""
    host = f"lower(regexp_extract(coalesce({url}, ''), {lit('^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:]*)')}, 1))"
    said = lambda tag: whole_text(f"{page}.pieces", first_tag(f"{page}.elements", tag))
    unless = lambda v, c, *others: f"if({' or '.join(f'coalesce({v}.{c} = {v}.{o}, false)' for o in others)}, null, {v}.{c})"

    def rows(v: Text) -> Text:
        lines = (
            ("URL host", f"{v}.host", None), ("Title", f"{v}.title", 400), ("H1", f"{v}.h1", 200), ("Site name", f"{v}.site", 200), ("OG title", f"{v}.og", 400),
            ("OG description", f"{v}.about", 400), ("Meta description", unless(v, "described", "about"), 400), ("Schema.org name", unless(v, "name", "og", "site"), 200),
            ("Schema.org description", unless(v, "summary", "about", "described"), 400), ("Author", f"{v}.author", 200), ("Stats", f"{v}.stats", None),
        )
        return "array_compact(array(" + ", ".join(let(c, lambda x, label=label, most=most: f"if({x} != '', concat({lit(f'{label}: ')}, {short(x, most) if most else x}), null)") for label, c, most in lines) + "))"

    def values(metas: Text, data: Text) -> Text:
        of_ = {
            "host": host, "title": said("title"), "h1": said("h1"), "site": meta(metas, "og:site_name"), "og": meta(metas, "og:title", "twitter:title"), "about": meta(metas, "og:description", "twitter:description"),
            "described": meta(metas, "description"), "name": from_linked_data(data, "name", "headline"), "summary": from_linked_data(data, "description"), "author": author_text(page, metas, data),
            "stats": f"array_join({stats(page)}, ' | ')",
        }
        return "struct(" + ", ".join(f"{c} as {n}" for n, c in of_.items()) + ")"

    found = let(metas_of(page), lambda m: let(linked(page), lambda d: values(m, d)))
    return F.expr(let(let(found, rows), lambda x: f"if(size({x}) > 0, concat('## Page Identifiers\\n', array_join({x}, '\\n')), '')"))


def descriptions(page: Text, most: int = 4) -> Column:
    """Up to `most` texts that may describe the page, the longest first; empty without any."""
    elements, pieces = f"{page}.elements", f"{page}.pieces"

    def paragraph(e: Text, texts: Text) -> Text:
        """The text of a paragraph without notes, from 40 characters on."""
        notes = intervals(inside(e, elements), lambda x: tagged(x, "sup", "sub"))
        own = let(notes, lambda ns: of("transform", part(texts, f"{e}.begin", f"{e}.stop"), lambda t, i: f"if({within(f'({i} + {e}.begin)', ns)}, null, {strip(t)})", index=True))
        return let(plain(f"array_join({only(own, lambda t: f'{t} != {lit(str())}')}, ' ')"), lambda t: f"if(length({t}) >= 40, {t}, null)")

    def found(texts: Text) -> Text:
        box = f"coalesce({first_tag(elements, 'main')}, {first(elements, lambda e: f'coalesce({attr(e, str('role'))} = {lit("main")}, false)')}, {first_tag(elements, 'article')})"
        of_box = lambda b: only(each(only(inside(b, elements), lambda e: tagged(e, "p")), lambda e: paragraph(e, texts)), lambda t: f"{t} is not null")
        lead = let(box, lambda b: f"if({b} is null, null, get({of_box(b)}, 0))")
        next_p = lambda h: first(elements, lambda e: f"{e}.number > {h}.number and {tagged(e, 'p')}")
        after = let(first_tag(elements, "h1"), lambda h: let(f"if({h} is null, null, {next_p(h)})", lambda e: f"if({e} is null, null, {paragraph(e, texts)})"))
        metas = lambda m: f"array({meta(m, 'og:description', 'twitter:description')}, {meta(m, 'description')}, {from_linked_data(linked(page), 'description')}, {lead}, {after})"
        return let(metas_of(page), metas)

    texts = only(each(let(shown(pieces, unseen(elements)), found), strip), lambda t: f"{t} != ''")
    # the longest first, of equals the earlier one
    ranked = let(texts, lambda ts: f"array_sort({of('transform', ts, lambda t, i: f'struct(-length({t}) as n, {i} as i, {plain(t)} as t)', index=True)})")
    best = f"slice({once(ranked, lambda x: f'lower(left({x}.t, 80))')}, 1, {most})"
    lines = each(best, lambda x: f"concat('- ', {short(f'{x}.t', 1500)})")
    return F.expr(let(lines, lambda x: f"if(size({x}) > 0, concat('## Candidate descriptions\\n', array_join({x}, '\\n')), '')"))


def wants_description(fields: list[Field]) -> bool:
    return any(x in f.name.lower() for f in fields for x in DESCRIPTION_FIELDS)


def read_pages(pages: DataFrame, fields: list[Field]) -> DataFrame:
    """(page_id, cleaned, identifiers, descriptions) for every row of pages (page_id, url, html); one parse each.

    descriptions is empty unless a field wants one. Null html: nulls. Null url: no host. Empty table: no rows.
    """
    rows = outlined(pages.select("page_id", "url", "html", F.col("html").isNotNull().alias("__there")))
    made = {"cleaned": cleaned("page", "url", fields), "identifiers": identifiers("page", "url"), "descriptions": descriptions("page") if wants_description(fields) else F.lit("")}
    return rows.select("page_id", *[F.when(F.col("__there"), c).alias(n) for n, c in made.items()])
