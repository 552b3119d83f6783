"""Main text of web pages: the article's blocks, without what belongs to the site.

1. Every page is parsed and its block elements' subtrees are hashed bottom-up (tag, class, text, children's hashes).
2. Spark counts, per host, on how many different pages each hash lies. Pages of a host with the same article count once, so copies of an article don't make it a template. A subtree on MANY pages or more that are also
   SHARE or more of the host's pages is a template of the site. A host has at most (elements a page) / SHARE templates, whatever its number of pages; its pages are never gathered.
3. Every page is parsed again with its host's templates: those subtrees go, with all that HTML itself marks as no article (navigation, headers, footers, sidebars, forms, scripts, ...: by element,
   role or a word of class or id, hidden elements). Prose (paragraphs, headings, quotes, tables) inside article or main stays though it recurs: documents share passages.

The article is the outermost article elements, else main, else the body. Blocks end where an element that is not inline starts or ends. A header inside an article keeps its headings.

Nulls: a null html is empty, and has an empty text; a null url or one without host is of no site, so nothing recurs there. A null page_id stays. Repeated rows give their text each. Broken markup
is closed as browsers do for blocks (implied ends of p, li, table parts, ...); a comment, script or tag that never ends reaches to the end. Very long pages are read whole, in linear time.
No rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_rows

#: A subtree is a template where so many different pages of a host have it, and such a share of them.
MANY, SHARE = 4, 0.25

_words = lambda text: frozenset(text.split())
TAG = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^>\s]*+))*+)>|<[!?][^>]*>?|</?[a-zA-Z][^>]*\Z""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/]+)(?:\s*=\s*("[^"]*"|'[^']*'|\S+))?""")
#: Elements whose content is no markup.
RAW = _words("script style textarea title iframe noembed noframes xmp")
VOID = _words("area base br col embed hr img input link meta param source track wbr")
INLINE = _words("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br label")
#: Elements that are never part of an article.
OUT = RAW | _words("head nav footer aside form noscript template svg canvas audio video object embed button select option datalist input dialog menu meta link base")
ROLES = _words("navigation banner contentinfo complementary search form menu menubar toolbar dialog alert alertdialog")
#: Words of class or id that mark what is no article.
MARKED = _words(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager header masthead topbar footer sidebar aside widget widgets ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo "
    "promotion banner cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments commentlist "
    "disqus reply replies respond discussion toolbar search copyright"
)
TALK = _words("comment comments commentlist disqus reply replies respond discussion related recommended")
PROSE = _words("p h1 h2 h3 h4 h5 h6 blockquote pre table dl figcaption")
HEADINGS = _words("h1 h2 h3 h4 h5 h6 hgroup")
CLOSES_P = _words("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt")
#: start tag -> (open elements that it ends, elements beyond which it ends none)
_CELLS, _LISTS = _words("table html"), _words("ul ol menu dl dir table td th html")
IMPLIED = {
    "li": (_words("li"), _LISTS), "dd": (_words("dd dt"), _LISTS), "dt": (_words("dd dt"), _LISTS), "option": (_words("option"), _words("select html")), "td": (_words("td th"), _CELLS), "th": (_words("td th"), _CELLS),
    "tr": (_words("tr td th caption"), _CELLS), "tbody": (_words("tbody thead tfoot tr td th caption colgroup"), _CELLS), "thead": (_words("tbody thead tfoot tr td th caption colgroup"), _CELLS), "tfoot": (_words("tbody thead tfoot tr td th caption colgroup"), _CELLS),
    "body": (_words("head"), _words("html")),
}
_P, _BARRIER, _TABLE, _NONE = _words("p"), _words("table td th caption button object template html"), _words("table tr td th tbody thead tfoot"), _words("")


class Page:
    """A page's elements in order, each with its parent, and its texts and block edges in order."""

    def __init__(self, source: str):
        self.tags, self.attributes, self.parents, self.parts, self.events = ["html"], [""], [-1], [[]], []
        stack, at, events = [0], 0, self.events
        depths = defaultdict(list, {"html": [0], "": [0]})  # tag -> where in the stack it is open; '' for all but inline elements
        deepest = lambda tags: max((depths[t][-1] for t in tags if depths[t]), default=-1)

        def close(depth):
            for k in stack[depth:]:
                depths[self.tags[k]].pop()
                if self.tags[k] not in INLINE:
                    depths[""].pop()
            del stack[depth:]

        def end(which, barrier):
            """Close the innermost of these elements, with all inside it, if no barrier is nearer."""
            depth = deepest(which)
            if depth <= max(0, deepest(barrier - which)):
                return False
            events.append((stack[depth], None))
            close(depth)
            return True

        body = False
        while True:
            m = TAG.search(source, at)
            text = source[at : m.start() if m else len(source)]
            if text:
                text = html.unescape(text)
                if not text.isspace() or self.tags[stack[-1]] in INLINE or events:
                    events.append((stack[-1], text))
                    self.parts[stack[-1]].append(text)
            if not m:
                return
            at, name = m.end(), m[2]
            if not name:
                continue
            name = name.lower()
            if m[1]:
                if name in ("body", "html"):
                    continue
                if name in INLINE:  # never closes a block
                    if (depth := deepest([name])) > depths[""][-1]:
                        close(depth)
                elif not end(frozenset([name]), _NONE if name in _TABLE else _BARRIER):
                    events.append((stack[-1], None))
                continue
            if name == "html" or (name == "body" and body):
                continue
            body = body or name == "body"
            if name in CLOSES_P:
                end(_P, _BARRIER)
            if name in IMPLIED:
                which, barrier = IMPLIED[name]
                while end(which, barrier):
                    pass
            elif name in HEADINGS and self.tags[stack[-1]] in HEADINGS:
                end(HEADINGS, _BARRIER)
            if name == "br":
                events.append((stack[-1], " "))
                self.parts[stack[-1]].append(" ")
                continue
            k = len(self.tags)
            self.tags.append(name)
            self.attributes.append(m[3])
            self.parents.append(stack[-1])
            self.parts.append([])
            self.parts[stack[-1]].append(k)
            if name not in INLINE:
                events.append((k, None))
            if name in RAW:
                last = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                at = last.end() if last else len(source)
            elif name not in VOID:
                depths[name].append(len(stack))
                if name not in INLINE:
                    depths[""].append(len(stack))
                stack.append(k)

    def hashes(self) -> list[bytes | None]:
        """Each subtree's hash, None where it has no text."""
        found = [None] * len(self.tags)
        for k in range(len(self.tags) - 1, -1, -1):
            parts = [found[p] if isinstance(p, int) else b" ".join(p.encode("utf-8", "surrogatepass").split()) for p in self.parts[k] if not isinstance(p, int) or found[p]]
            if any(parts):
                marks = self.marks(k)
                found[k] = hashlib.blake2b(b"\0".join([self.tags[k].encode(), marks.get("class", "").encode("utf-8", "surrogatepass"), *(p for p in parts if p)]), digest_size=8).digest()
        return found

    def marks(self, k: int) -> dict[str, str]:
        return {a.lower(): html.unescape(v.strip("\"'")) for a, v in ATTRIBUTE.findall(self.attributes[k])} if self.attributes[k].strip(" /\n\t") else {}

    def roots(self) -> set[int]:
        """The outermost articles that are no comments, else main, else everything. One below a marked element (a sidebar) only where there is no other, one among comments only where there is none of these."""
        for wanted in (lambda k, m: self.tags[k] == "article", lambda k, m: self.tags[k] == "main" or m.get("role") == "main"):
            inside, below = [False] * len(self.tags), [0] * len(self.tags)
            roots: tuple[set[int], ...] = (set(), set(), set())
            for k in range(1, len(self.tags)):
                up = self.parents[k]
                inside[k], below[k] = inside[up], below[up]
                if inside[k]:
                    continue
                if self.tags[k] in OUT and self.tags[k] != "form":
                    inside[k] = True  # nothing in there is the article
                    continue
                marks = self.marks(k)
                marked = self.tags[k] != "body" and self.marked(marks)
                if wanted(k, marks):
                    inside[k] = True
                    if not marked:
                        roots[below[k]].add(k)
                if marked:
                    below[k] = max(below[k], 2 if self.marked(marks, TALK) else 1)
            if any(roots):
                return next(r for r in roots if r)
        return {0}

    @staticmethod
    def marked(marks: dict[str, str], words: frozenset[str] = MARKED) -> bool:
        return bool(words & set(re.split(r"[^a-z0-9]+", f"{marks.get('class', '')} {marks.get('id', '')}".lower())))

    def text(self, templates: frozenset[bytes] = frozenset()) -> str:
        """The roots' blocks, without what is no article."""
        n, roots = len(self.tags), self.roots()
        hashes = self.hashes() if templates else [None] * n
        heads = [False] * n  # holds a first heading
        for k in range(n - 1, 0, -1):
            heads[k] = heads[k] or self.tags[k] == "h1"
            if heads[k]:
                heads[self.parents[k]] = True
        whole = 0 in roots
        inside, prose, kept, only_headings = [whole] * n, [False] * n, [True] * n, [False] * n
        for k in range(1, n):
            up, tag = self.parents[k], self.tags[k]
            inside[k] = inside[up] or k in roots
            kept[k] = kept[up] or k in roots
            prose[k] = prose[up] or (tag in PROSE and not whole and inside[up])
            only_headings[k] = only_headings[up] and tag not in HEADINGS
            if k in roots or not kept[k] or not inside[k] or tag == "body":
                continue
            marks = self.marks(k)
            if tag == "header" and not whole:
                only_headings[k] = True
            elif (
                tag in OUT
                or tag == "header"
                or "hidden" in marks
                or marks.get("aria-hidden") == "true"
                or marks.get("role") in ROLES
                or re.search(r"display:\s*none|visibility:\s*hidden", marks.get("style", ""))
                or (self.marked(marks) and not heads[k])
                or (tag not in INLINE and not prose[k] and hashes[k] in templates and hashes[k] and not (heads[k] and not whole))
            ):
                kept[k] = False
        blocks, now = [], []
        for k, text in self.events:
            if text is None:
                blocks.append(" ".join("".join(now).split()))
                now = []
            elif inside[k] and kept[k] and not only_headings[k]:
                now.append(text)
        blocks.append(" ".join("".join(now).split()))
        return "\n\n".join(b for b in blocks if b)


def host(url: Column) -> Column:
    """The host of a url, lower case; '' where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")))


def subtrees(pages: DataFrame) -> DataFrame:
    """host, article (hash of the main content), hashes (of the block elements' subtrees, each once): one row a page with a host."""

    def start():
        def body(rows):
            out = []
            for site, source in rows:
                page = Page(source)
                found = page.hashes()
                number = [int.from_bytes(h, "little", signed=True) if h else None for h in found]
                main = hashlib.blake2b(b"".join(found[k] or b"" for k in sorted(page.roots())), digest_size=8).digest()
                blocks = {number[k] for k in range(1, len(found)) if found[k] and page.tags[k] not in INLINE and page.tags[k] not in ("body", "head", "article", "main")}
                out.append((site, int.from_bytes(main, "little", signed=True), sorted(blocks)))
            return out

        return body

    rows = pages.select(host(pages["url"]).alias("host"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html")).where("host <> ''")
    return map_rows(rows, start, "host string, article long, hashes array<long>")


def templates(pages: DataFrame, many: int = MANY, share: float = SHARE) -> DataFrame:
    """host, templates: the hashes of the subtrees that recur on many of its pages."""
    found = cut(subtrees(pages), "subtrees")
    sizes = found.select("host", "article").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    seen = found.select("host", "article", F.explode("hashes").alias("hash")).distinct()  # so a hot host's pages are counted in parts
    counts = seen.groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= many)
    return counts.join(sizes, "host").where(F.col("n") >= F.col("pages") * share).groupBy("host").agg(F.sort_array(F.collect_list("hash")).alias("templates"))


def extract(pages: DataFrame, many: int = MANY, share: float = SHARE) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    known = cut(templates(pages, many, share), "templates")
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"), host(pages["url"]).alias("host"))

    def start():
        sites: dict[tuple, frozenset] = {}

        def body(batch):
            out = []
            for page_id, url, source, recurring in batch:
                key = tuple(recurring or ())
                if key not in sites:
                    if len(sites) >= 1000:
                        sites.clear()
                    sites[key] = frozenset(h.to_bytes(8, "little", signed=True) for h in key)
                text = Page(source).text(sites[key])
                out.append((page_id, url, text, len(text)))
            return out

        return body

    # The templates are a written table: Spark sends it to every task where its files are small, else joins by host and splits hot hosts.
    joined = rows.join(known, "host", "left").select("page_id", "url", "html", "templates")
    return map_rows(joined, start, "page_id long, url string, text string, n_chars long")
