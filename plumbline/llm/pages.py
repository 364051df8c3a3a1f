"""Main text of web pages by paths that the pages of a host agree on.

Each page is cut into blocks of text; every block scores for the container it stands in, half as much for the one around
it, by its length without links. A container's name is its path of tags and classes, numbers generalised. From the best
container a page climbs to the article around it, or to the box that holds its headline, while what that adds is not mostly
links; it votes for that path. Votes are summed per host in Spark, and paths with a fair share of a host's votes win. Each
page is then read again by the path of highest worth, where a path that won counts ``VOTED`` times its worth; pages without
a host have their own best path only.

Left out are menus, headers, footers, sidebars, notices, adverts, forms and comments: by tag, role or a class that says
nothing else, on containers; by an id only outside article, main and the path that gives the text. A class with other
words beside leaves a container out if its text is mostly links, and so is a header inside an article. Headings, paragraphs, cells, tables and inline
elements are never judged by class or id, only left out if hidden. Formulae and the text of objects belong to the article.

Defined cases: null and empty html give an empty text; a null or unreadable url has no host, its page gives its own best
container; tags may be left open, cut off, nested wrongly or thousands deep (time is linear in the page); repeated rows
vote and are extracted each; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.staging import stage

#: Part of a host's votes from which a path wins: at most 1 / SHARE paths per host.
SHARE = 0.2
#: A path that its host voted for counts as much as another path of this many times its worth.
VOTED = 100
#: Hosts up to this many are broadcast; beyond it, pages join them by a shuffle.
BROADCAST_HOSTS = 50_000

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?][^>]*>|<[/!?a-zA-Z][^>]*\Z""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "title"}
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I) for tag in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike",
           "strong", "sub", "sup", "time", "tt", "u", "var", "object",
           "math", "mrow", "mi", "mn", "mo", "ms", "mtext", "mspace", "msup", "msub", "msubsup", "mfrac", "msqrt", "mroot", "mover", "munder", "munderover", "mtable",
           "mtr", "mtd", "mstyle", "mpadded", "menclose", "mmultiscripts", "semantics", "annotation"}
#: Blocks of text: not containers, and closed by the next block.
_LEAF = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "li", "dt", "dd", "td", "th", "figcaption", "blockquote", "address", "caption", "summary"}
_LEFT_OUT = {"head", "nav", "header", "footer", "aside", "form", "button", "select", "menu", "dialog"}
_ROLES = {"navigation", "banner", "complementary", "contentinfo", "search", "form", "menu", "menubar", "alert", "dialog"}
_AWAY = set("""nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer colophon sidebar side aside widget widgets notice notices cookie cookies consent gdpr
banner alert ad ads advert adverts advertisement adbox adsense sponsor sponsored promo promotion popup modal overlay newsletter subscribe signup login form search share sharing social
related recommended recommendations comment comments commentlist reply replies respond disqus pagination pager hidden copyright legal disclaimer skip toolbar""".split())
#: Words that only say box or place: a class of these and words of _AWAY names what is left out.
_BOXES = set("""list area box wrapper wrap container section block inner item thread links posts teaser slot unit bar rail bottom top left right site global primary secondary
sticky user reader icons buttons widget body""".split())
_GOOD = {"article", "main", "content", "post", "entry", "story", "body", "text"}
#: Classes of boxes that hold a piece with its headline.
_PIECE = {"article", "post", "entry", "story"}
#: Never judged by class or id.
_UNJUDGED = {"html", "body", "main", "table", "thead", "tbody", "tfoot", "tr", "figure", "details"}
_WORDS = re.compile(r"[a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for key, a, b, c in _ATTRIBUTE.findall(text) if text else ():
        out.setdefault(key.lower(), a or b or c)
    return out


def _hidden(given: dict[str, str]) -> bool:
    return "hidden" in given or given.get("aria-hidden") == "true" or _HIDDEN.search(given.get("style", "")) is not None


def _away(value: str) -> tuple[bool, bool]:
    """Whether a class or id says nothing but what is left out; whether it says so beside other words."""
    whole = partly = False
    for one in _HUMP.sub("-", value).lower().split():
        words = set(_WORDS.findall(one))
        if words & _AWAY:
            whole, partly = whole or words <= _AWAY | _BOXES, True
    return whole, partly and not whole


class Page:
    """Blocks of a page, its containers (the parent before the child, number 0 around all) and their paths.

    A path is a number, a link to the path around it and a digest of all names on the way.
    """

    def __init__(self, html: str):
        self.parent, self.path_of, self.good, self.out, self.by_id, self.doubtful, self.inside = [-1], [0], [False], [False], [False], [False], [False]
        self.around, self.names, self.keys, self.tags, self.piece, self.known = [-1], [""], [""], [""], [False], {}
        self.blocks: list[tuple[int, str, int, bool]] = []  # container, text, characters inside links, a headline
        self._read(html)
        self._without_link_lists()
        self._sum()

    def _add(self, parent: int, tag: str, attributes: str) -> int:
        given = _attributes(attributes)
        names, role = given.get("class", "").lower(), given.get("role", "").lower()
        in_article = self.inside[parent] == "article"
        out, doubtful, by_id = tag in _LEFT_OUT or role in _ROLES or _hidden(given), False, False
        if tag == "header" and in_article and not role:
            out, doubtful = False, True
        if tag not in _UNJUDGED and (tag != "article" or in_article):
            whole, partly = _away(given.get("class", ""))
            out, doubtful = out or whole, doubtful or partly
            by_id = _away(given.get("id", ""))[0]
        article = tag == "article" or role == "article"
        inside = "article" if article or in_article else self.inside[parent] or ("main" if tag == "main" or role == "main" else False)
        words = set(_WORDS.findall(names))
        name = ".".join([tag, *sorted(re.sub(r"[0-9]+", "#", x) for x in names.split())])
        above = self.path_of[parent]
        path = self.known.get((above, name))
        if path is None:
            path = self.known[above, name] = len(self.names)
            self.around.append(above)
            self.names.append(name)
            self.keys.append(blake2b(f"{self.keys[above]}/{name}".encode("utf-8", "surrogatepass"), digest_size=16).hexdigest())
            self.tags.append("article" if article else tag)
            self.piece.append(bool(inside) or not words.isdisjoint(_PIECE))
        self.parent.append(parent)
        self.path_of.append(path)
        self.good.append(bool(article or inside and not self.inside[parent] or words & _GOOD))
        self.out.append(self.out[parent] or out)
        self.by_id.append(not inside and (self.by_id[parent] or by_id))
        self.doubtful.append(doubtful)
        self.inside.append(inside)
        return len(self.parent) - 1

    def _read(self, html: str) -> None:
        stack, tags, opened = [0], [""], Counter()
        held, linked, in_link, at, n = [], 0, False, 0, len(html)
        leaves: list[tuple[str, bool]] = []  # open blocks, and whether they are hidden
        endless: set[str] = set()  # inline tags that are not closed any more

        def flush():
            nonlocal linked
            if held:
                if not (self.out[stack[-1]] or any(hidden for _, hidden in leaves)):
                    text = " ".join(entities.unescape("".join(held)).split())
                    if text:
                        self.blocks.append((stack[-1], text, linked, bool(leaves) and leaves[-1][0] == "h1"))
                held.clear()
            linked = 0

        while at < n:
            token = _TOKEN.search(html, at)
            end = token.start() if token else n
            if end > at:
                held.append(html[at:end])
                linked += in_link and end - at
            if not token:
                break
            at = token.end()
            tag = (token[2] or token[5] or "").lower()
            if not tag:
                continue
            closing, attributes = token[1] or token[4], (token[3] or token[6] or "")
            if tag in _RAW:
                if not closing and not attributes.endswith("/"):
                    over = _RAW_END[tag].search(html, at)
                    at = over.end() if over else n
                held.append(" ")
            elif tag == "a":
                in_link = not closing
            elif tag in _INLINE:
                if not closing and attributes and tag not in endless and _hidden(_attributes(attributes)):
                    over = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                    at = over.end() if over else at
                    if not over:
                        endless.add(tag)
            elif tag in _VOID:
                if tag == "hr":
                    flush()
                held.append(" ")
            elif tag in _LEAF:
                flush()
                if closing:
                    while any(t == tag for t, _ in leaves):
                        if leaves.pop()[0] == tag:
                            break
                else:
                    if tag not in ("li", "td", "th", "dd", "blockquote"):
                        leaves = [x for x in leaves if x[0] in ("li", "td", "th", "dd", "blockquote")]
                    else:
                        leaves = [x for x in leaves if x[0] != tag]
                    leaves.append((tag, bool(attributes) and _hidden(_attributes(attributes))))
            else:
                flush()
                leaves.clear()
                in_link = False
                if not closing:
                    if not attributes.endswith("/"):
                        stack.append(self._add(stack[-1], tag, attributes))
                        tags.append(tag)
                        opened[tag] += 1
                elif opened[tag]:
                    while True:
                        stack.pop()
                        last = tags.pop()
                        opened[last] -= 1
                        if last == tag:
                            break
        flush()

    def _without_link_lists(self) -> None:
        """Drop blocks in doubtful containers of a path whose text is mostly links."""
        if not any(self.doubtful):
            return
        text, links = [0] * len(self.parent), [0] * len(self.parent)
        for node, t, linked, _ in self.blocks:
            text[node] += len(t)
            links[node] += linked
        for node in range(len(self.parent) - 1, 0, -1):
            text[self.parent[node]] += text[node]
            links[self.parent[node]] += links[node]
        held, linked = Counter(), Counter()
        for node, doubtful in enumerate(self.doubtful):
            if doubtful:
                held[self.path_of[node]] += text[node]
                linked[self.path_of[node]] += links[node]
        gone = [False] * len(self.parent)
        for node in range(1, len(self.parent)):
            path = self.path_of[node]
            gone[node] = gone[self.parent[node]] or self.doubtful[node] and 2 * linked[path] >= held[path]
        self.blocks = [x for x in self.blocks if not gone[x[0]]]

    def _sum(self) -> None:
        """Scores of the containers' paths by themselves; text, links, worth and headlines of paths with all inside."""
        if any(not self.by_id[node] for node, *_ in self.blocks):
            counted = [x for x in self.blocks if not self.by_id[x[0]]]
        else:
            counted = self.blocks  # the whole page stands in a box with such an id
        size = len(self.names)
        self.scores: dict[int, float] = {}
        self.text, self.links, self.worth, self.headline = [0] * size, [0] * size, [0.0] * size, [False] * size
        for node, text, linked, headline in counted:
            path, worth = self.path_of[node], _worth(text, linked)
            self.text[path] += len(text)
            self.links[path] += linked
            self.worth[path] += worth
            self.headline[path] |= headline
            for share in (1.0, 0.5, 0.25):
                path = self.path_of[node]
                self.scores[path] = self.scores.get(path, 0.0) + worth * share * (1.5 if self.good[node] else 1.0)
                node = self.parent[node]
                if node <= 0:
                    break
        for path in range(size - 1, 0, -1):
            above = self.around[path]
            self.text[above] += self.text[path]
            self.links[above] += self.links[path]
            self.worth[above] += self.worth[path]

    def best(self) -> int | None:
        """The path of highest score, the first of equals, climbed to what belongs to it."""
        if not self.scores:
            return None
        path = max(self.scores, key=lambda p: (self.scores[p], -p))
        while self.tags[path] != "article":
            above = self.around[path]
            if above <= 0 or self.tags[above] in ("html", "body") or not (self.piece[above] or self.headline[above]):
                break
            if 2 * (self.links[above] - self.links[path]) > self.text[above] - self.text[path]:
                break
            path = above
        return path

    def path(self, number: int) -> str:
        names = []
        while number > 0:
            names.append(self.names[number])
            number = self.around[number]
        return "".join(f"/{x}" for x in reversed(names))

    def under(self, path: int) -> str:
        """Text of the blocks in containers of a path."""
        loose = path == 0 or self.tags[path] in ("html", "body")
        held = [path == 0] * len(self.names)
        for one in range(1, len(self.names)):
            held[one] = one == path or held[self.around[one]]
        kept = [x for x in self.blocks if held[self.path_of[x[0]]]]
        if loose:
            kept = [x for x in kept if not self.by_id[x[0]]] or kept
        return "\n".join(text for _, text, _, _ in kept)


def _worth(text: str, linked: int) -> float:
    return max(len(text) - 2 * linked, 0) + 10.0 * sum(map(text.count, ".,;:!?"))


def _votes(htmls: pd.Series) -> pd.DataFrame:
    rows = []
    for html in htmls:
        page = Page(html or "")
        best = page.best()
        rows.append((None, None) if best is None else (page.keys[best], page.path(best)))
    return pd.DataFrame(rows, columns=["key", "path"])


def extract(html: str, winners: list[str]) -> str:
    """Text of a page whose host voted for the paths with these keys."""
    page = Page(html or "")
    best = page.best()
    if best is None:
        return ""
    voted = set(winners)
    mine = [p for p, key in enumerate(page.keys) if key in voted and page.text[p]]
    if mine:
        path = max(mine, key=lambda p: (page.scores.get(p, 0.0), -p))
        best = path if VOTED * page.worth[path] >= page.worth[best] else best
    return page.under(best)


def _extracted(htmls: pd.Series, winners: pd.Series) -> pd.Series:
    return pd.Series([extract(h, list(w) if w is not None else []) for h, w in zip(htmls, winners)], index=htmls.index, dtype=object)


def host(url):
    """Host of a url in lower case, without port and user; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def winning_paths(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """host, winners, paths: keys and names of the paths with at least ``SHARE`` of the host's votes."""
    # otherwise the filter below is moved under the projection, and every page is read twice
    best = F.pandas_udf(_votes, "key string, path string").asNondeterministic()(F.col(html))
    votes = pages.select(host(F.col(url)).alias("host"), best.alias("b")).where("b.key IS NOT NULL AND host <> ''")
    sums = votes.groupBy("host", F.col("b.key").alias("key")).agg(F.count(F.lit(1)).alias("votes"), F.min("b.path").alias("path"))
    # one row per host and path here
    share = F.col("votes") / F.sum("votes").over(Window.partitionBy("host"))
    won = sums.withColumn("share", share).where(F.col("share") >= SHARE)
    return won.groupBy("host").agg(F.sort_array(F.collect_list("key")).alias("winners"), F.sort_array(F.collect_list("path")).alias("paths"))


def main_text(pages: DataFrame, html: str = "html", url: str = "url", into: str = "text") -> DataFrame:
    """``pages`` with the main text in ``into``."""
    winners = stage(winning_paths(pages, html, url)).select(F.col("host").alias("__host"), F.col("winners").alias("__winners"))
    side = F.broadcast(winners) if winners.count() <= BROADCAST_HOSTS else winners
    joined = pages.join(side, host(F.col(url)) == F.col("__host"), "left")
    return joined.withColumn(into, F.pandas_udf(_extracted, "string")(F.col(html), F.col("__winners"))).drop("__host", "__winners")
