"""Main text of web pages by template deduction from equivalence classes.

Tokens are tags, told apart by their open container and, for containers, by class or id (long numbers apart), and whole text nodes outside
the article. A token's occurrence vector over
the pages of its host is kept as an order-free hash (exclusive or over pages of a hash of page and count), so it is
summed map-side and no host is ever gathered. Tokens of one vector are an equivalence class. The class of tokens that
stand once on every page of the host is the root of its template; classes of two or more tokens (an opening and its
end tag at least) that stand on half of the pages nest in the root's gaps. The gaps between template tokens are slots.

Every page is cut at the containers whose tags are root or nested tokens of its host; a slot is the text between them, told
apart by its path of such containers. Each slot is judged over the host's pages (``judge``): how many pages hold it, how many different texts
it has, how much of it is links, how much text a page. Fixed slots and slots of links are boilerplate; of the others the one with most text is main (inside
an article or main element where one has a fair share of it), and with it those inside the article, and outside those that
are rich and do not repeat on a page, as comments do. The tag list is a check: what stands in a menu, header, footer, sidebar, form, hidden
element, script, style or comment section is no slot. A class word counts when it is a whole class token (``sponsored-box``, not
``has-sidebar``); it never drops an article or main element, but for comments and teasers, nor an article inside its container, and of the words that texts use as
well (``_UNSURE``) it drops a container inside an article only where the slots confirm it. Hosts of fewer than TEXT_PAGES pages
and pages without text in the chosen slots are read by the list alone: article, or main element, or else the body.

Outside an article, text nodes that are template tokens (on at least TEXT_PAGES pages and half of the host) are boilerplate as well;
passages that pages share inside one stay. Blocks follow block elements, a line break is white space.

Cases: null html counts as empty and gives an empty text; a null address is the host ''; a host with one page has a template of its own
tags, which lose no text; unclosed and stray tags are tolerated, and an article that opens in an unclosed menu is read; long pages
are whole and read in linear time; rows that repeat an id are separate pages, and a page that stands in several rows of a host counts
once in its template and its slots, so that repeats change no text; other columns are ignored; an empty table gives no rows."""
from __future__ import annotations

import hashlib
import html as references
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augeval.llm.textops import set_batches
from augeval.session import cut_lineage

TEXT_PAGES = 5
BROADCAST_BYTES = 16 << 20
_MASK = (1 << 64) - 1
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)|<[!?/][^>]*>|[^<]+|<", re.S)
_TAIL = re.compile(r"<!--.*?(?:-->|\Z)|()()(?!)|[^<]+|<", re.S)  # behind the last > of a page
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "object", "select", "button", "canvas",
        "audio", "video", "noframes"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
_CONTAINERS = {"html", "head", "body", "div", "nav", "ul", "ol", "li", "article", "section", "header", "footer", "aside", "main", "table",
               "form", "figure", "blockquote", "dl", "details", "fieldset", "dialog", "menu", "center"}
_BLOCKS = _CONTAINERS | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "dt", "dd",
                         "figcaption", "address", "summary", "hr", "option", "legend", "hgroup"}
_BOILERPLATE_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "head"}
_BOILERPLATE_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "banner", "sidebar", "menu",
                      "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "cookie", "cookies", "consent", "notice", "notices", "popup",
                      "modal", "newsletter", "subscribe", "comments", "comment", "commentlist", "disqus", "replies", "footer", "share", "sharing",
                      "social", "related", "toolbar", "pagination", "pager", "login", "signup", "masthead", "complementary", "contentinfo", "search"}
_KEEP_SKIPPING = {"comments", "comment", "commentlist", "disqus", "replies", "related", "aside", "sidebar"}
_COMMENTS = {"comments", "comment", "commentlist", "disqus", "replies"}
_UNSURE = {"banner", "menu", "nav", "navigation", "notice", "notices", "footer", "header", "share", "sharing", "social", "related", "search", "consent",
           "cookie", "cookies", "complementary", "contentinfo", "login", "signup", "modal", "promo", "sponsor", "subscribe"}
# Words that say nothing by themselves, beside a boilerplate word in a class token.
_PLAIN = {"box", "block", "container", "wrapper", "wrap", "area", "section", "list", "item", "items", "widget", "bar", "panel", "unit", "slot", "links",
          "inner", "outer", "top", "bottom", "left", "right", "site", "page", "global", "main", "buttons", "button", "posts", "articles", "body", "entry", "thread", "div"}
_TEASERS = {"teaser", "teasers", "article", "card"}
_SLOTS = {"body", "div", "article", "section", "header", "footer", "aside", "main", "nav", "form", "center", "details", "fieldset"}
_DEEP = 30           # containers of a slot's path
RICH = 0.2           # text a page, against the main slot, of a rich slot
PAGE = "<page>"


class Block(NamedTuple):
    text: str
    article: bool
    main: bool
    doubt: int       # 1: inside a container with an unsure class word, 2: with a sure one
    slot: str
    linked: int      # characters in links
    head: bool       # in a first heading
    side: bool       # in an article or main element inside a side container (teasers, or all the text of the page)


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")


def _named(token: str) -> str:
    return token if len(token) <= 60 else f"{token[0]}#{_hash(token):016x}"


def _marks(attributes: str) -> tuple[set[str], str, bool, bool]:
    """Boilerplate words of class, id and role, the label of the element, whether it is a teaser and whether it is hidden."""
    words, label, teaser, hidden = set(), "", False, False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role"):
            if name == "class" or name == "id" and not label:
                label = "." + re.sub(r"\d{3,}", "#", ".".join(value.split()))
            for token in value.split():
                parts = {w.lower() for w in _WORD.findall(token) if not w.isdigit()}
                bad = parts & (_BOILERPLATE_WORDS | {"header"})
                if bad and parts <= bad | _PLAIN:
                    words |= bad
                teaser |= bool(parts & {"teaser", "teasers"}) and parts <= _TEASERS | _PLAIN
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            hidden = True
    return words, label, teaser, hidden


class Open(NamedTuple):
    name: str
    label: str
    boilerplate: bool
    endable: bool    # may be ended by an article
    outer: tuple[int, bool, str]  # doubt, side and slot around it


class Reader:
    """One pass over a page: its tokens, its blocks, and how often each slot of the template's containers opens."""

    def __init__(self, page: str, template: frozenset[str] = frozenset()):
        self.page, self.template = page, template
        self.tokens: list[str] = []
        self.blocks: list[Block] = []
        self.runs: dict[str, int] = {}
        self.stack: list[Open] = []
        self.parts: list[str] = []
        self.article = self.main = 0
        self.skip = 0
        self.doubt, self.side, self.slot = 0, False, ""
        self.linked, self.link, self.head = 0, False, False
        self.last = {c: page.rfind(c) for c in ">\"'"}
        self.ends: dict[int, int] = {}     # by > or quote outside quotes: place behind the tag that it stands in
        self.ahead = (0, -1)               # a place and the first > or quote from there on
        self.unended: set[str] = set()
        self.read()

    def flush(self) -> None:
        if self.parts:
            text = " ".join(references.unescape("".join(self.parts)).split())
            if text:
                self.blocks.append(Block(text, self.article > 0, self.main > 0, self.doubt, self.slot, min(self.linked, len(text)), self.head,
                                         self.side and (self.article > 0 or self.main > 0)))
            self.parts, self.linked = [], 0

    def pop(self) -> None:
        o = self.stack.pop()
        self.skip -= o.boilerplate
        self.article -= o.name == "article"
        self.main -= o.name == "main"
        self.doubt, self.side, self.slot = o.outer

    def open(self, name: str, attributes: str) -> str:
        """Puts the element on the stack and returns its token."""
        bad, label, teaser, hidden = _marks(attributes) if attributes else (set(), "", False, False)
        label = name if name in ("html", "body", "article", "main") else name + label
        own = name in ("article", "main")
        if own:
            bad = bad & _COMMENTS
            teaser = teaser and name == "article"
            if not bad and not teaser and not hidden:
                while self.skip and any(o.boilerplate for o in self.stack):  # an element that was never closed
                    if not self.stack[-1].boilerplate or self.stack[-1].endable:
                        self.pop()
                    else:
                        break
        elif name in ("html", "body") or self.article:
            bad = set() if name in ("html", "body") else bad - {"header"}
        boiler = hidden or name in _BOILERPLATE_TAGS or bool(bad & _COMMENTS) or (own and teaser) or (name == "header" and not self.article)
        if name in ("html", "body"):
            boiler = False
        parent = self.stack[-1].label if self.stack else ""
        self.stack.append(Open(name, label, boiler, boiler and not (bad | {name}) & _KEEP_SKIPPING, (self.doubt, self.side, self.slot)))
        self.skip += boiler
        self.article += name == "article"
        self.main += name == "main"
        if own:
            self.doubt = 0
        elif bad:
            self.doubt = max(self.doubt, 2 if bad - _UNSURE else 1)
            self.side = self.side or not (self.article or self.main) and bool(bad & _KEEP_SKIPPING)
        token = f"{parent}<{label}"
        if name in _SLOTS and self.template and _named(token) in self.template and self.slot.count("/") < _DEEP:
            self.slot += "/" + label
            self.runs[self.slot] = self.runs.get(self.slot, 0) + 1
        return token

    def close(self, name: str) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].name == name:
                while len(self.stack) > k:
                    self.pop()
                return
            if self.stack[k].name in ("article", "main", "body") and name not in ("article", "main", "body", "html"):
                return

    def tag_end(self, at: int) -> int:
        """Place behind the first > from ``at`` on that is outside quotes, -1 if there is none. Every > and quote is followed once a page."""
        page, way, end = self.page, [], -1
        first = True
        while True:
            if first and self.ahead[0] <= at <= self.ahead[1]:
                stop = self.ahead[1]
            else:
                m = _STOP.search(page, at)
                stop = m.start() if m else -1
                if first and m:
                    self.ahead = (at, stop)
            first = False
            if stop < 0:
                break
            if stop in self.ends:
                end = self.ends[stop]
                break
            way.append(stop)
            if page[stop] == ">":
                end = stop + 1
                break
            if stop == self.last[page[stop]]:
                break
            at = page.find(page[stop], stop + 1) + 1
        self.ends.update(dict.fromkeys(way, end))
        return end

    def read(self) -> None:
        page, at, end = self.page, 0, len(self.page)
        while at < end:
            m = (_TOKEN if at < self.last[">"] else _TAIL).match(page, at)
            token, name, at = m[0], m[2], m.end()
            if name is not None:
                start, at = at, self.tag_end(at)
                attributes = page[start:at - 1]
                if at < 0:  # no tag: an end is passed over up to the next >, else the < is text
                    name, at = None, page.find(">", start) + 1 if m[1] else m.start() + 1
                    token = page[m.start():at]
            if name is None:
                if token[0] != "<" or len(token) == 1:
                    if not self.skip:
                        self.parts.append(token)
                        if self.link:
                            self.linked += len(token.strip())
                continue
            name = name.lower()
            ending = m[1] == "/"
            if not ending:
                if name == "body":  # ends an unclosed head
                    while self.stack and self.stack[-1].name == "head":
                        self.pop()
            path = self.stack[-1].label if self.stack else ""
            if name in _RAW and not ending:
                self.tokens.append(f"{path}<{name}")
                if not attributes.endswith("/"):
                    stop = None if name in self.unended else re.compile(rf"</{name}\s*>", re.I).search(page, at)
                    if not stop:
                        self.unended.add(name)
                    at = stop.end() if stop else (end if name in ("script", "style") else at)
                    if stop:
                        self.tokens.append(f"</{name}")
                continue
            if name in _BLOCKS:
                self.flush()
                self.head, self.link = name == "h1" and not ending, False
            elif name == "br" and not self.skip:
                self.parts.append(" ")
            elif name == "a":
                self.link = not ending
            if name not in _CONTAINERS or not ending and attributes.endswith("/"):
                self.tokens.append(f"</{name}" if ending else f"{path}<{name}")
            elif ending:
                self.tokens.append("</" + next((o.label for o in reversed(self.stack) if o.name == name), name))
                self.close(name)
            else:
                self.tokens.append(self.open(name, attributes))
        self.flush()


def _page_tokens(page: str) -> dict[str, int]:
    r = Reader(page)
    count: dict[str, int] = {PAGE: 1}
    for t in r.tokens:
        count[t] = count.get(t, 0) + 1
    for b in r.blocks:
        if not b.article:
            count["=" + b.text] = count.get("=" + b.text, 0) + 1
    return count


def _vectors():
    """Per batch and (host, token): pages, occurrences and the hash of the occurrence vector (combined before the shuffle)."""
    def run(batches):
        for b in batches:
            seen: dict[tuple[str, str], list[int]] = {}
            for host, page, text in zip(*[b.column(c).to_pylist() for c in ("host", "page", "html")], strict=True):
                for token, n in _page_tokens(text).items():
                    s = seen.setdefault((host, _named(token)), [0, 0, 0])
                    s[0] += 1
                    s[1] += n
                    x = ((page & _MASK) * 0x9E3779B97F4A7C15 + n * 0xD6E8FEB86659FD93) & _MASK
                    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
                    s[2] ^= (x ^ (x >> 27)) >> 1
            keys = list(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
                 *[pa.array([seen[k][i] for k in keys], pa.int64()) for i in range(3)]], names=["host", "token", "pages", "n", "vector"])
    return run


def _hosted(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))


def repeated(pages: DataFrame) -> DataFrame:
    """(host, page): the pages that stand in several rows of a host, told apart by a 64-bit hash of the html; written."""
    rows = _hosted(pages).select("host", F.xxhash64("html").alias("page"))
    return cut_lineage(rows.groupBy("host", "page").count().where("count > 1").select("host", "page"), "template-repeats")


def _once(pages: DataFrame, again: DataFrame) -> DataFrame:
    """(host, page, html) with every different page of a host once: only the pages in several rows are shuffled."""
    rows = _hosted(pages).select("host", F.xxhash64("html").alias("page"), "html")
    size = again.agg(F.sum(F.length("host") + 32)).first()[0] or 0
    again = F.broadcast(again) if size <= BROADCAST_BYTES else again
    return rows.join(again, ["host", "page"], "left_anti").union(
        rows.join(again, ["host", "page"], "left_semi").dropDuplicates(["host", "page"]).select(*rows.columns))


def templates(pages: DataFrame, again: DataFrame | None = None) -> DataFrame:
    """(page_id, url, html) -> host, n_pages, root (tokens once on every page), nested (classes in its gaps), texts (template
    text nodes), all over the different pages of the host (``again``: those that ``repeated`` found). Each list is bounded by the
    tokens of a page, as its tokens stand on half of the pages or more."""
    set_batches(pages.sparkSession)
    rows = _once(pages, repeated(pages) if again is None else again).mapInArrow(
        _vectors(), "host string, token string, pages long, n long, vector long")
    tokens = rows.groupBy("host", "token").agg(F.sum("pages").alias("pages"), F.sum("n").alias("n"), F.bit_xor("vector").alias("vector"))
    tokens = cut_lineage(tokens, "template-tokens")
    root = tokens.where(F.col("token") == PAGE).select("host", F.col("pages").alias("n_pages"), F.col("vector").alias("root_vector"))
    often = tokens.join(root, "host").where("2 * pages >= n_pages").where(F.col("token") != PAGE)
    tags = often.where("not startswith(token, '=')")
    classes = tags.groupBy("host", "n_pages", "vector", (F.col("vector") == F.col("root_vector")).alias("is_root")).agg(
        F.sort_array(F.collect_list("token")).alias("tokens"))
    per_host = classes.groupBy("host", "n_pages").agg(
        F.flatten(F.collect_list(F.when(F.col("is_root"), F.col("tokens")))).alias("root"),
        F.collect_list(F.when(~F.col("is_root") & (F.size("tokens") > 1), F.col("tokens"))).alias("nested"))
    texts = often.where(F.col("pages") >= TEXT_PAGES).where("startswith(token, '=')").groupBy("host").agg(F.collect_list("token").alias("texts"))
    return per_host.join(texts, "host", "left").select("host", "n_pages", "root", "nested", F.coalesce("texts", F.array().cast("array<string>")).alias("texts"))


def _slots():
    """Per page and slot: hash of its text, characters, those in links, in doubt (unsure words) and out (sure words, or any outside an
    article), how often it opens, whether it has a first heading, and characters inside an article or main element, and of those in side containers."""
    def run(batches):
        for b in batches:
            known: dict[tuple, frozenset[str]] = {}
            out: list[list] = [[] for _ in SLOT_NAMES]
            for host, page, template in zip(*[b.column(c).to_pylist() for c in ("host", "html", "template")], strict=True):
                key = tuple(template or ())
                r = Reader(page, known.setdefault(key, frozenset(key)))
                found: dict[str, list] = {}
                for x in r.blocks:
                    s = found.setdefault(x.slot, [[], 0, 0, 0, 0, 0, 0, 0])
                    inside, n = x.article or x.main, len(x.text)
                    s[0].append(x.text)
                    doubt = n * (x.doubt == 1 and inside)
                    for k, v in enumerate((n, x.linked, doubt, n * (x.doubt > 0) - doubt, int(x.head), n * inside, n * x.side)):
                        s[k + 1] += v
                for slot, s in found.items():
                    for column, value in zip(out, [host, slot, _hash("\n".join(s[0])) >> 1, *s[1:5], r.runs.get(slot, 1), int(s[5] > 0), *s[6:]], strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k < 2 else pa.int64()) for k, c in enumerate(out)], names=SLOT_NAMES)
    return run


SLOT_NAMES = ["host", "slot", "hash", "chars", "linked", "doubt", "out", "runs", "heads", "inside", "side"]


def judge(slots: list[dict]) -> dict[str, bool]:
    """Slots of a host (pages, texts, chars, linked, doubt, out, runs, heads, inside, side: sums over its pages) -> whether each is main text."""
    def prose(s):
        return s["chars"] - s["linked"]

    def a_page(s):
        return prose(s) / s["pages"]

    def repeats(s):
        return s["runs"] > 1.5 * s["pages"]

    varying = [s for s in slots if 2 * s["texts"] > s["pages"] and 2 * s["linked"] < s["chars"] and 2 * s["out"] < s["chars"]]
    if not varying:
        return {}
    most = max(map(prose, varying))
    fair = [s for s in varying if 2 * s["inside"] > s["chars"] and prose(s) >= RICH * most]
    best = max([s for s in fair if 2 * s["side"] < s["chars"]] or fair or varying, key=lambda s: (prose(s), s["slot"]))
    at = best["slot"]
    article = next((i for i, x in enumerate(at.split("/")) if x in ("article", "main")), None)
    root = "/".join(at.split("/")[:article + 1]) if article is not None else None
    out = {s["slot"]: False for s in slots}
    for s in varying:
        rich = a_page(s) >= RICH * a_page(best)
        if s is best:
            keep = True
        elif root is not None and (s["slot"] + "/").startswith(root + "/"):
            keep = rich or 2 * s["doubt"] < s["chars"]
        elif root is not None and (2 * s["inside"] <= s["chars"] or s["side"] and not best["side"]):
            keep = False
        else:
            keep = (rich or s["heads"] * 2 > s["pages"]) and (not repeats(s) or repeats(best))
        out[s["slot"]] = keep
    return out


def _judged(batches):
    for b in batches:
        main, other = [], []
        for slots in b.column("slots").to_pylist():
            verdict = judge(slots or [])
            main.append(sorted(k for k, v in verdict.items() if v))
            other.append(sorted(k for k, v in verdict.items() if not v))
        yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(main, pa.list_(pa.string())), pa.array(other, pa.list_(pa.string()))],
                                         names=["host", "main", "other"])


def _joined(hosted: DataFrame, hosts: DataFrame) -> DataFrame:
    lists = [c for c, t in hosts.dtypes if t == "array<string>"]
    size = hosts.agg(F.sum(sum((F.length(F.concat_ws("", c)) for c in lists), F.length("host") + 24))).first()[0] or 0
    return hosted.join(F.broadcast(hosts) if size <= BROADCAST_BYTES else hosts, "host", "left")


def host_slots(pages: DataFrame, hosts: DataFrame, again: DataFrame | None = None) -> DataFrame:
    """(host, main, other): the slots of each host with TEXT_PAGES pages or more that are main text and that are not."""
    once = _once(pages, repeated(pages) if again is None else again).drop("page")
    rows = _joined(once, hosts.where(F.col("n_pages") >= TEXT_PAGES).select("host", "template")).where("template is not null") \
        .select("host", "html", "template").mapInArrow(_slots(), ", ".join(f"{c} {'string' if c in ('host', 'slot') else 'long'}" for c in SLOT_NAMES))
    added = [F.sum(c).alias(c) for c in SLOT_NAMES[3:]]
    texts = rows.groupBy("host", "slot", "hash").agg(F.count("*").alias("pages"), *added)
    sums = texts.groupBy("host", "slot").agg(F.sum("pages").alias("pages"), F.count("*").alias("texts"), *added)
    per_host = sums.groupBy("host").agg(F.collect_list(F.struct(*[c for c in sums.columns if c != "host"])).alias("slots"))
    return per_host.mapInArrow(_judged, "host string, main array<string>, other array<string>")


def main_text(page: str, texts: set[str], template: frozenset[str] = frozenset(), slots: dict[str, bool] | None = None) -> str:
    """Blocks of the main slots of a page under the template texts, the template containers and the judged slots of its host, one to a line."""
    blocks, slots = Reader(page, template).blocks, slots or {}
    own = [b for b in blocks if b.article or _named("=" + b.text) not in texts]
    held = [b for b in own if slots.get(b.slot) and b.doubt < (2 if b.article or b.main else 1)]
    if not held:  # by the list alone
        held = [b for b in blocks if b.article and not b.side and b.doubt < 2 and not (b.doubt and slots.get(b.slot) is False)]
    if not held:
        inside = [b for b in blocks if b.main and not b.side and b.doubt < 2] or [b for b in blocks if not b.doubt and not b.side]
        held = [b for b in inside if _named("=" + b.text) not in texts]
        side = [b for b in blocks if b.side and b.doubt < 2]
        if not any(b.main for b in held) and sum(len(b.text) for b in side) > sum(len(b.text) for b in held):
            held = side
    return "\n".join(b.text for b in held)


def extract(pages: DataFrame) -> DataFrame:
    """All rows of (page_id, url, html) -> page_id, url, text, n_chars, n_template (template tokens of the host)."""
    again = repeated(pages)
    t = cut_lineage(templates(pages, again).withColumn("template", F.filter(F.concat("root", F.flatten("nested")), lambda x: ~x.startswith("</"))), "templates")
    t = t.select("host", "n_pages", "texts", "template", (F.size("root") + F.size("nested")).alias("n_template"))
    t = cut_lineage(t.join(host_slots(pages, t, again), "host", "left").drop("n_pages"), "template-slots")

    def run(batches):
        for b in batches:
            known: dict[tuple, tuple] = {}
            out = []
            for page, *lists in zip(*[b.column(c).to_pylist() for c in ("html", "texts", "template", "main", "other")], strict=True):
                key = tuple(tuple(x or ()) for x in lists)
                if key not in known:
                    known[key] = set(key[0]), frozenset(key[1]), dict.fromkeys(key[2], True) | dict.fromkeys(key[3], False)
                out.append(main_text(page, *known[key]))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string()),
                                              pa.array([len(x) for x in out], pa.int64()), b.column("n_template").cast(pa.int64())],
                                             names=["page_id", "url", "text", "n_chars", "n_template"])
    set_batches(pages.sparkSession)
    return _joined(_hosted(pages), t).select("page_id", "url", "html", "texts", "template", "main", "other", F.col("n_template").cast("long").alias("n_template")) \
        .mapInArrow(run, "page_id long, url string, text string, n_chars long, n_template long")
