"""HTML extraction: template deduction by equivalence classes of tokens.

Tokens of a page are its tag paths (tag, class names, place among like siblings, below the parent's path) and its text blocks.  A token's
occurrence vector says how often it occurs in each distinct page of a host; tokens of equal vectors form a class.  Vectors are compared by an
additive fingerprint (a sum over pages of a hash of the page and the count), so a host is never gathered anywhere: partial sums are
combined before the shuffle, however many pages a host has.  Classes of at least two tokens that occur in ``SUPPORT`` of the pages are valid; their tag paths
nest, by parent, into the host's template, a tree of shells.  The text blocks of valid classes are template text; all else are slots.

The main slot is found by descending from the root into the shell that occurs once a page and holds most of the text that neither repeats nor is a
link, until the text lies loose in the slot itself.  Tags break ties: an ``article`` goes before its siblings, and menus, footers, sidebars and named
boilerplate don't count.  The text of a page is its main slot; within it only what tags or whole class names say to be a menu, a sidebar, an advert, a notice, a form or
reader comments is left out, a vaguer word (``related``, ``legal``) only where the template says so too (the shell holds template text or links), and nothing of an ``article`` for
being repeated.  Before the main slot, a heading and the shell around it stay (title and lead); other shells beside it don't.

Hosts of fewer than ``LEAST_PAGES`` distinct pages have no template (a vector of three pages says too little); there, in pages without the main
slot's shell, and where nothing of a host varies, ``article`` and ``main`` elements stand for the main slot.  A page without either is taken whole, without boilerplate by
tag or word, template text, and blocks that are mostly links.

A page is parsed once: blocks and paths are written to the shared folder, and counting and choosing work on those.  An element costs a bounded number of bytes and steps, whatever its depth.

Defined cases: a null page is empty and gives an empty text; pages without a host are a host of their own;
a host's rows of equal html count as one page, however many they are.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .shared import materialize
from .textops import U64, bounded_batches, lean, mix
from .urlfilter import host_of

#: distinct pages that a host needs for a template; share of them that a template token needs
LEAST_PAGES, SUPPORT = 4, 0.5
#: share of a shell's varying text that the next shell down needs; text that may lie loose beside it; share of repeated or linked text that makes a shell boilerplate; least share of an article
MAJOR, LOOSE, BORING, ARTICLE_SHARE = 0.5, 0.1, 0.5, 0.1
#: templates of up to so many tokens in all (8 bytes each) are broadcast; larger ones are joined
BROADCAST_TOKENS = 4_000_000
#: the same for repeated contents, each of which takes as much as so many tokens
CONTENT_TOKENS = 8
#: in that join, a hot host's pages are spread over so many keys
SALTS = 64

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_TELLING = re.compile(r"class|id|role|hidden|style", re.IGNORECASE)
_RAW = {t: re.compile(rf"</{t}\s*>|\Z", re.IGNORECASE) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "template", "svg")}

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "legend", "summary"}
#: elements that end an open one of their kind, and those that stop the search for it
_ENDS = {"li": ("li",), "option": ("option",), "tr": ("tr",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th")}
_STOPS = ("ul", "ol", "dl", "table", "tbody", "select", "menu")
#: elements that may be shells of a template; their place among like siblings is part of their path
_SHELLS = frozenset("article aside body center div footer form head header html main nav section table td".split())
_PARAGRAPHS = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hgroup ol p pre ul".split())
_OUT = frozenset("nav footer aside script style noscript template iframe object svg canvas button select textarea dialog menu head audio video".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar status".split())
#: words that name boilerplate; that may; and that say nothing
_NAMES = frozenset(
    """ad ads adbox adslot advert adverts advertisement advertisements advertising adsense sponsored sponsors breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus footer gdpr masthead menu menus
    nav navbar navigation newsletter notice notices noticebox notification notifications pager pagination paywall popup popups respond searchbox searchform sidebar sidebars submenu subscribe toolbar topbar""".split()
)
_HINTS = frozenset(
    """alert alerts aside banner banners crumbs disclaimer discussion discussions feedback foot form forms head header legal login modal copyright overlay popular promo promoted promos promotion rail recommendations recommended register
    related replies reply search share shares sharing signup skip social sponsor stories subscription teaser trending widget widgets""".split()
)
_NEUTRAL = frozenset("area bar block body bottom box buttons column container content grid group holder inner item items left list main outer panel post posts reader readers region right section site slot thread title top unit user users wrap wrapper".split())
_COMMENTS = frozenset("comment comments reply replies respond disqus related recommended teaser".split())
#: in names of what a layout has, lacks or allows
_LAYOUT, _STATES = frozenset("has no with without".split()), frozenset("open closed enabled disabled on off".split())
_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_DIGITS = re.compile(r"\d+")

#: marks of an element: boilerplate by tag, role or being hidden; by a whole name; perhaps, by a word; a form; article or main; main; header; heading; a shell; a paragraph or the like; html or body; a whole name that may be boilerplate's
FIRM, NAMED, HINT, FORM, ARTICLE, MAIN, HEADER, HEADING, SHELL, PARAGRAPH, BODY, VAGUE = (1 << k for k in range(12))


def _marks(tag: str, attributes: str) -> tuple[int, str]:
    """(marks, class names for the path) of an element by its own tag and attributes."""
    out = (SHELL if tag in _SHELLS else 0) | (PARAGRAPH if tag in _PARAGRAPHS else 0) | (HEADING if tag in ("h1", "h2", "h3") else 0)
    if tag == "main":
        return out | ARTICLE | MAIN, ""
    if tag in ("html", "body"):
        return out | BODY, ""
    own = {}
    if attributes and _TELLING.search(attributes):
        for k, v in _ATTRIBUTE.findall(attributes):
            own.setdefault(k.lower(), v.strip("\"'"))
    names = f"{own.get('class', '')} {own.get('id', '')} {tag if '-' in tag else ''}".split()
    parts = [{w.lower() for w in _SPLIT.findall(n)} for n in names]
    parts = [p for p in parts if not p & _LAYOUT]
    if tag == "article":
        return out | (FIRM if any(p & _COMMENTS and not p & _STATES for p in parts) else ARTICLE), ""
    role = own.get("role", "").lower()
    if tag in _OUT or role in _ROLES or "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", "").lower():
        out |= FIRM
    if any(p & _NAMES and p <= _NAMES | _HINTS | _NEUTRAL and not p & _STATES for p in parts):
        out |= NAMED
    elif any(p & (_NAMES | _HINTS) for p in parts):
        out |= HINT | (VAGUE if any(p & _HINTS and p <= _HINTS | _NEUTRAL and not p & _STATES for p in parts) else 0)
    if tag == "form" or role == "form":
        out |= FORM
    if tag == "header":
        out |= HEADER
    return out, " ".join(sorted(_DIGITS.sub("0", own.get("class", "")).split()))


class Page:
    """Text blocks of a page, with the node and the characters within links of each; and its distinct tag paths, the nodes, parents first.

    Of a node: path, parent, marks, number of elements, and the characters and link characters below it that aren't in boilerplate by tag or name.
    """

    __slots__ = ("at", "chars", "count", "linked", "links", "marks", "parents", "paths", "texts")

    def __init__(self, texts, at, links, paths, parents, marks, count, chars, linked):
        self.texts, self.at, self.links, self.paths, self.parents, self.marks, self.count, self.chars, self.linked = texts, at, links, paths, parents, marks, count, chars, linked


_ROOT = xxhash.xxh64_intdigest("") - (1 << 63)
#: most elements of one kind that are told apart by their place
PLACES = 9
_memo: dict[tuple[str, str], tuple[int, str]] = {}


def parse(page: str) -> Page:
    texts: list[str] = []
    at_node: list[int] = []
    links: list[int] = []
    paths, parents, marks, count = [_ROOT], [-1], [0], [1]
    known: dict[tuple, int] = {}
    # open elements: tag, node, whether their text is left out as an inline element is, like siblings seen below
    tags, nodes, muted, seats = [""], [0], [False], [None]
    open_at: dict[str, list[int]] = {}
    blocks_at = [0]
    parts: list[str] = []
    link_chars = 0
    place, size = 0, len(page)

    def close() -> None:
        nonlocal link_chars
        if parts:
            text = "".join(parts)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            parts.clear()
            if text:
                texts.append(text)
                at_node.append(nodes[-1])
                links.append(min(link_chars, len(text)))
            link_chars = 0

    def cut(k: int) -> None:
        for tag in reversed(tags[k:]):
            open_at[tag].pop()
            if tag in _BLOCK:
                blocks_at.pop()
        del tags[k:], nodes[k:], muted[k:], seats[k:]

    while place < size:
        m = _TOKEN.search(page, place)
        end = m.start() if m else size
        if end > place and not muted[-1]:
            parts.append(page[place:end])
            if open_at.get("a"):
                link_chars += end - place
        if not m:
            break
        place = m.end()
        tag = m.group(2) or m.group(5)
        if not tag:
            continue
        tag = tag.lower()
        if m.group(1) or m.group(4):
            if tag in _BLOCK:
                close()
            elif tag == "br":
                parts.append(" ")
            spots = open_at.get(tag)
            if spots and (tag in _BLOCK or spots[-1] > blocks_at[-1]):
                cut(spots[-1])
            continue
        if tag == "br":
            parts.append(" ")
            continue
        block = tag in _BLOCK
        if block:
            close()
            if tag in _CLOSES_P and tags[blocks_at[-1]] == "p":
                cut(blocks_at[-1])
            if tag in _ENDS:
                same = max((open_at[t][-1] for t in _ENDS[tag] if open_at.get(t)), default=-1)
                if same > max((open_at[t][-1] for t in _STOPS if open_at.get(t)), default=-1):
                    cut(same)
        attributes = m.group(3) or m.group(6) or ""
        if tag in _RAW and not attributes.endswith("/"):
            place = _RAW[tag].search(page, place).end()
            continue
        if tag in _VOID or attributes.endswith("/") and not block:
            continue
        if block or attributes or tag in _OUT or "-" in tag:
            key = (tag, attributes)
            if key not in _memo:
                if len(_memo) > 4096:
                    _memo.clear()
                _memo[key] = _marks(tag, attributes)
            own, names = _memo[key]
        else:
            own, names = 0, ""
        node, out = nodes[-1], muted[-1]
        if block:
            seat = 0
            if own & SHELL:
                if seats[-1] is None:
                    seats[-1] = {}
                seat = seats[-1].get((tag, names), 0)
                seats[-1][tag, names] = min(seat + 1, PLACES)
            spot = known.setdefault((node, tag, names, own, seat), len(paths))
            if spot == len(paths):
                paths.append(xxhash.xxh64_intdigest(f"{paths[node]}/{tag}.{names}#{seat}:{own}") - (1 << 63))
                parents.append(node)
                marks.append(own)
                count.append(1)
            else:
                count[spot] += 1
            node = spot
            blocks_at.append(len(tags))
        elif own & (FIRM | NAMED):
            out = True
        open_at.setdefault(tag, []).append(len(tags))
        tags.append(tag)
        nodes.append(node)
        muted.append(out)
        seats.append(None)
    close()
    chars, linked = [0] * len(paths), [0] * len(paths)
    for i, text, link in zip(at_node, texts, links):
        chars[i] += len(text)
        linked[i] += link
    for i in range(len(paths) - 1, 0, -1):
        if not marks[i] & (FIRM | NAMED):
            chars[parents[i]] += chars[i]
            linked[parents[i]] += linked[i]
    return Page(texts, at_node, links, paths, parents, marks, count, chars, linked)


def _text_tokens(texts: list[str], paths: np.ndarray) -> np.ndarray:
    return mix(np.fromiter(map(xxhash.xxh64_intdigest, texts), U64, len(texts)) ^ mix(paths.view(U64))).view(np.int64)


class Template:
    """What is known of a host: template text, boilerplate shells, and the main slot's shell."""

    __slots__ = ("boring", "main", "often")

    def __init__(self, often=(), boring=(), main=None):
        self.often, self.boring, self.main = frozenset(often), frozenset(boring), main


def _mains(p: Page, template: Template) -> set[int]:
    """The nodes that hold the main text; none for a page that is taken whole."""
    n = len(p.paths)
    wrapped = [0] * n
    inner = [False] * n
    found: set[int] = set()
    for i in range(1, n):
        k, own = p.parents[i], p.marks[i]
        wrapped[i] = 2 if own & FIRM else max(wrapped[k], 1 if own & (NAMED | VAGUE) else 0)
        inner[i] = inner[k]
        if own & ARTICLE and not inner[k] and (wrapped[i] == 0 or wrapped[i] == 1 and own & MAIN):
            found.add(i)
            inner[i] = True
    deduced = {i for i in range(n) if p.paths[i] == template.main} if template.main is not None else set()
    if deduced and not any(p.marks[i] & ARTICLE for i in deduced):
        return deduced
    if deduced:  # other articles of the page go with the deduced one; what holds it is not a slot of its own
        above = set()
        for i in deduced:
            while i > 0:
                i = p.parents[i]
                above.add(i)
        return deduced | {i for i in found if i not in above and p.paths[i] not in template.boring}
    return found


def choose(p: Page, template: Template = Template()) -> str:
    """The text of the main slot."""
    n = len(p.paths)
    mains = _mains(p, template)
    whole = not mains
    holds, heads = [False] * n, [False] * n
    for i in range(n - 1, 0, -1):
        k = p.parents[i]
        holds[k] |= holds[i] or i in mains
        heads[i] |= bool(p.marks[i] & HEADING)
        heads[k] |= heads[i]
    first = min(mains, default=n)
    # per node: 0 beside the main slot, 1 in it; whether it is left out (2: for good); in an article; below a header, a heading, a hint
    inside, out, article, header, heading, hinted = ([0] * n for _ in range(6))
    for i in range(n):
        own, k = p.marks[i], p.parents[i]
        boring = p.paths[i] in template.boring
        if i in mains or i == 0 and whole:
            inside[i] = 1
            article[i] = int(bool(own & ARTICLE) or k >= 0 and article[k])
        elif inside[k]:
            inside[i] = 1
            article[i] = int(article[k] or bool(own & ARTICLE))
            header[i] = int(header[k] or bool(own & HEADER))
            heading[i] = int(heading[k] or bool(own & HEADING))
            hinted[i] = int(hinted[k] or bool(own & HINT))
            vague = own & HINT and (boring or whole and not article[i]) or own & ARTICLE and hinted[k] and not whole
            out[i] = max(out[k], 2 if own & FIRM else 1 if own & (NAMED | FORM) or vague or boring and not article[i] else 0)
            if whole and own & ARTICLE and out[i] < 2:
                out[i] = header[i] = 0
        elif not holds[i]:
            bad = own & (FIRM | NAMED | FORM | HINT | HEADER) or boring
            if k < 0 or holds[k]:
                out[i] = int(not (i < first and not bad and (own & PARAGRAPH or heads[i])))
            else:
                out[i] = int(bool(out[k] or bad))
        else:
            out[i] = 0
    tokens = _text_tokens(p.texts, np.array([p.paths[i] for i in p.at], np.int64)).tolist() if template.often else []
    keep = []
    for b, (text, i, links) in enumerate(zip(p.texts, p.at, p.links)):
        if out[i] or holds[i] and not inside[i] or header[i] and not (heading[i] and (article[i] or not whole)):
            continue
        if not article[i] and (template.often and tokens[b] in template.often or (whole or not inside[i]) and links * 2 > len(text)):
            continue
        keep.append(text)
    return "\n".join(keep)


def main_text(page: str, template: Template = Template()) -> str:
    """The main text of one page."""
    return choose(parse(page), template)


_BLOCKS = "texts array<string>, at array<int>, links array<int>, paths array<long>, parents array<int>, marks array<int>, count array<int>, chars array<int>, linked array<int>"
_KINDS = [pa.string(), pa.int32(), pa.int32(), pa.int64(), *[pa.int32()] * 5]
_NAMES_OF = ["texts", "at", "links", "paths", "parents", "marks", "count", "chars", "linked"]


def _parsed(batches):
    for batch in batches:
        pages = [parse(page or "") for page in batch.column(3).to_pylist()]
        columns = [pa.array([getattr(p, name) for p in pages], pa.list_(kind)) for name, kind in zip(_NAMES_OF, _KINDS)]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), batch.column(4), *columns], names=["id", "url", "host", "seed", *_NAMES_OF])


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first of each group in it) that brings equal keys together."""
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order, np.flatnonzero(new)


def _sum(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, first) if len(first) else x[:0]


_TOKENS = "host long, token long, n double, hi long, lo long, parent long, marks int, count double, chars double, linked double"


def _stats(batches):
    """Per batch and host: each token's pages (a row is a share of its page), fingerprint halves, parent path; marks are -1 for text."""
    for batch in batches:
        host, seed, share = (batch.column(k).to_numpy() for k in range(3))
        texts, at, paths, parents, marks, count, chars, linked = (batch.column(k) for k in range(3, 11))
        flat = lambda c: c.flatten().to_numpy(zero_copy_only=False)
        sizes = lambda c: np.diff(c.offsets.to_numpy())
        path = flat(paths)
        begin = np.cumsum(sizes(paths)) - sizes(paths)
        row = np.repeat(np.arange(batch.num_rows), sizes(paths))
        up = flat(parents)
        parent = path[begin[row] + np.maximum(up, 0)]
        out = _tokens(host[row], path, parent, flat(marks), flat(count), share[row], seed[row], flat(chars) * share[row], flat(linked) * share[row])
        own = flat(texts).tolist()
        row = np.repeat(np.arange(batch.num_rows), sizes(texts))
        above = path[begin[row] + flat(at)]
        token = _text_tokens(own, above)
        length = np.fromiter(map(len, own), np.float64, len(own))
        order, first = _groups(token, row)
        times = np.diff(np.append(first, len(order)))
        one = order[first]
        row = row[one]
        found = _tokens(host[row], token[one], above[one], np.full(len(one), -1, np.int32), times, share[row], seed[row], length[one] * times * share[row], np.zeros(len(one)))
        columns = [np.concatenate(x) for x in zip(out, found)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.int64(), pa.float64(), *[pa.int64()] * 3, pa.int32(), *[pa.float64()] * 3])], names=[x.split()[0] for x in _TOKENS.split(", ")])


def _tokens(host, token, parent, marks, count, share, seed, chars, linked) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        f = mix(count.astype(U64) * U64(0x9E3779B97F4A7C15) + seed.view(U64))
    order, first = _groups(token, host)
    one = order[first]
    total = lambda x: _sum(x[order], first)
    return [host[one], token[one], total(share), total((f >> U64(32)).astype(np.int64)), total((f & U64(0xFFFFFFFF)).astype(np.int64)), parent[one], marks[one], total(count * share), total(chars), total(linked)]


def deduce(tokens: list[dict]) -> tuple[list[int], list[int], int | None]:
    """(template text, boilerplate shells, main slot's shell) of a host from its frequent tokens."""
    nodes = {t["token"]: t for t in tokens if t["marks"] >= 0}
    root = nodes[_ROOT]
    # nested classes: members below what is in the template; a class that loses all but one goes, and what is below it
    alive = {_ROOT, *nodes}
    while True:
        size: dict[tuple, int] = {}
        for t in tokens:
            if t["marks"] < 0 or t["token"] in alive:
                c = (t["n"], t["hi"], t["lo"])
                size[c] = size.get(c, 0) + 1
        ok = {k for k in alive if k == _ROOT or nodes[k]["parent"] in alive and size[nodes[k]["n"], nodes[k]["hi"], nodes[k]["lo"]] > 1}
        if ok == alive:
            break
        alive = ok
    often = [t for t in tokens if t["marks"] < 0 and size[t["n"], t["hi"], t["lo"]] > 1]
    repeated = dict.fromkeys(nodes, 0.0)
    for t in often:
        k = t["parent"]
        while k in nodes:
            repeated[k] += t["chars"]
            if k == _ROOT or nodes[k]["marks"] & (FIRM | NAMED):
                break
            k = nodes[k]["parent"]
    varying = {k: max(0.0, nodes[k]["chars"] - nodes[k]["linked"] - repeated[k]) for k in nodes}
    below: dict[int, list[int]] = {}
    for k in alive:
        if k != _ROOT:
            below.setdefault(nodes[k]["parent"], []).append(k)
    if varying[_ROOT] <= 0:
        return [], [], None
    at, chain = _ROOT, {_ROOT}
    while True:
        shells = [k for k in below.get(at, ()) if nodes[k]["marks"] & SHELL and not nodes[k]["marks"] & (FIRM | NAMED) and round(nodes[k]["count"]) == nodes[k]["n"]]
        told = [k for k in shells if nodes[k]["marks"] & ARTICLE and varying[k] >= ARTICLE_SHARE * varying[at]]
        best = max(told or shells, key=lambda k: (varying[k], k), default=None)
        if best is None or nodes[at]["marks"] & ARTICLE and not nodes[at]["marks"] & MAIN:
            break
        loose = varying[at] - sum(varying[k] for k in below[at] if not nodes[k]["marks"] & (FIRM | NAMED))
        if not told and (varying[best] < MAJOR * varying[at] or loose > LOOSE * varying[best]):
            break
        at = best
        chain.add(at)
    boring = [k for k in alive if k not in chain and nodes[k]["chars"] > 0 and repeated[k] + nodes[k]["linked"] >= BORING * nodes[k]["chars"]]
    # a main slot that is the whole body is none
    return sorted(t["token"] for t in often), sorted(boring), at if nodes[at]["marks"] & ARTICLE or not nodes[at]["marks"] & BODY and at != _ROOT else None


def templates(parsed: DataFrame) -> DataFrame:
    """(host, often, boring, main): the template of each host that has one.

    parsed: host long, seed long (equal for equal html of a host), share double (1 / rows of the seed), and blocks.  A host's row is bounded by its pages' size: a token that half of the pages have
    takes up half a token of the average page, so there are at most twice as many as an average page has.
    """
    tokens = parsed.select("host", "seed", "share", "texts", "at", "paths", "parents", "marks", "count", "chars", "linked").mapInArrow(lean(_stats), _TOKENS)
    # the shares of a page's rows make 1 but for rounding: sums are whole numbers of pages
    n = F.round(F.sum("n")).cast("long").alias("n")
    tokens = tokens.groupBy("host", "token").agg(n, *[F.sum(c).alias(c) for c in ("hi", "lo", "count", "chars", "linked")], F.max("parent").alias("parent"), F.max("marks").alias("marks"))
    hosts = parsed.groupBy("host").agg(F.round(F.sum("share")).cast("long").alias("pages")).where(f"pages >= {LEAST_PAGES}")
    often = tokens.where(f"n >= {LEAST_PAGES} * {SUPPORT}").join(hosts, "host").where(f"n >= {SUPPORT} * pages")
    host = often.groupBy("host").agg(F.collect_list(F.struct("token", "n", "hi", "lo", "parent", "marks", "count", "chars", "linked")).alias("tokens"))

    def run(batches):
        for batch in batches:
            found = [deduce(own) for own in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([f[k] for f in found], pa.list_(pa.int64())) for k in range(2)], pa.array([f[2] for f in found], pa.int64())], names=["host", "often", "boring", "main"])

    return host.mapInArrow(lean(run), "host long, often array<long>, boring array<long>, main long")


def _shared(parsed: DataFrame) -> DataFrame:
    """parsed with share, 1 / rows of its seed.

    Only hashes are shuffled, and only contents that repeat are joined; too many of them for a broadcast shuffle the pages.
    """
    again = parsed.groupBy("seed").agg(F.count("*").alias("rows")).where("rows > 1")
    again = materialize(parsed.sparkSession, again, "contents")
    if again.count() * CONTENT_TOKENS <= BROADCAST_TOKENS:
        again = F.broadcast(again)
    return parsed.join(again, "seed", "left").withColumn("share", F.lit(1.0) / F.coalesce("rows", F.lit(1)))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    spark = pages.sparkSession
    bounded_batches(spark)
    url = F.col(url_col).cast("string")
    df = pages.select(F.col(id_col).alias("id"), url.alias("url"), F.xxhash64(host_of(url)).alias("host"), F.col(html_col).cast("string").alias("html"))
    df = df.withColumn("seed", F.xxhash64("host", F.coalesce("html", F.lit(""))))
    kind = df.schema["id"].dataType.simpleString()
    parsed = materialize(spark, df.mapInArrow(lean(_parsed), f"id {kind}, url string, host long, seed long, {_BLOCKS}"), "blocks")
    template = materialize(spark, templates(_shared(parsed)), "templates")
    tokens = template.agg(F.sum(F.size("often") + F.size("boring") + 3)).first()[0] or 0
    template = template.withColumnRenamed("host", "t_host")
    if tokens <= BROADCAST_TOKENS:
        joined = parsed.join(F.broadcast(template), F.col("host") == F.col("t_host"), "left")
    else:
        template = template.withColumn("t_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = parsed.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int"))
        joined = salted.join(template, (F.col("host") == F.col("t_host")) & (F.col("salt") == F.col("t_salt")), "left")
    names = ["texts", "at", "links", "paths", "parents", "marks"]

    def run(batches):
        for batch in batches:
            made: dict[int, Template] = {}
            hosts, often, boring, main = (batch.column(k) for k in range(2, 6))
            texts = []
            for r, (host, *blocks) in enumerate(zip(hosts.to_pylist(), *(batch.column(k).to_pylist() for k in range(6, 12)))):
                if host not in made:
                    made[host] = Template(often[r].as_py() or (), boring[r].as_py() or (), main[r].as_py())
                texts.append(choose(Page(*blocks, None, None, None), made[host]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    joined = joined.select("id", "url", "host", "often", "boring", "main", *names)
    return joined.mapInArrow(lean(run), f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
