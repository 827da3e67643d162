"""Main text of web pages by minimum-cut labelling of their blocks.

A page becomes blocks of text in page order, a node for each run of like blocks in one section. A fixed logistic classifier gives every node its
costs of being content or boilerplate, the capacities of its edges to the two terminals; nodes that follow each
other or lie close in the DOM are tied by smoothness edges. The blocks on the
source's side of the minimum cut are the main text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements whose content is never text of the page.
_RAW = "script|style|template|iframe|select|textarea|button|title"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({_RAW})\b[^>]*(?:/>|>.*?(?:</\1\s*>|\Z))|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z/!?][^<>]*\Z", re.S | re.I)
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SECTIONS = frozenset("article aside body details dialog div figure footer form header main menu nav section table ul ol dl blockquote".split())
_BOILER = {"nav": -8.0, "footer": -8.0, "aside": -8.0, "form": -8.0, "menu": -8.0, "dialog": -8.0, "header": -5.0, "article": 4.0, "main": 3.0}
_ATTRIBUTE = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_BAD = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|promo\w*|sponsor\w*|cookies?|consent|notices?|alert|nav\w*|menu\w*|side ?bar|side|footer|header|masthead|comments?|disqus|replies|respond|share|sharing|social|related|recommend\w*|breadcrumbs?|subscribe|newsletter|popup|modal|overlay|widget|login|signup|pagination|pager|tags|copyright|legal|search|complementary|contentinfo|toolbar)(?=$|[\s_-])",
    re.I,
)
# Parts of a token that make it a state of the page or the subject of its text, not the role of a section: has-sidebar, category-legal, menu-open.
_STATE = re.compile(r"(?:^|[_-])(?:has|have|no|not|non|with|without|is|in|category|cat|tag|topic|subject|type|format|status|template|theme|layout|supports?|open|opened|closed|enabled|disabled|active|inactive|on|off|visible|hidden|shown|collapsed|expanded|loaded|ready|sticky|fixed)(?=$|[_-])", re.I)
_GOOD = re.compile(r"(?:^|[\s_-])(?:article|content|main|post|entry|story|body|text)(?=$|[\s_-])", re.I)


def marked(said: str) -> bool:
    """Whether a token of class, id or role names boilerplate; ``side bar`` is one name."""
    return bool(_BAD.search(" ".join(x for x in said.split() if not _STATE.search(x))))


def _exempt(blocks: list[tuple], sections: list[tuple], suspects: list[int]) -> set[int]:
    """Marked sections that hold the page's main text all the same.

    A section holds it if there is a main in it, or most of the text outside other boilerplate while what is central,
    if anything, lies inside it or around little more than it. Comments and lists of related pages hold articles too, so an
    article alone does not redeem them.
    """
    paths: dict[int, tuple[int, ...]] = {0: ()}

    def path_of(s: int) -> tuple[int, ...]:
        way = []
        while s not in paths:
            way.append(s)
            s = sections[s][0]
        for s in reversed(way):
            paths[s] = (*paths[sections[s][0]], s)
        return paths[way[0] if way else s]

    size: dict[int, int] = {}
    inside: dict[int, set[int]] = {}  # central sections with text in each section
    around: dict[int, tuple[int, ...]] = {}
    for text, _, section, _ in blocks:
        path = path_of(section)
        central = [c for c in path if sections[c][4]]
        for i, s in enumerate(path):
            size[s] = size.get(s, 0) + len(text)
            around[s] = path[:i]
            inside.setdefault(s, set()).update(c for c in central if c > s)
    central = sorted(s for s in size if sections[s][4])
    exempt = {s for s in suspects if any(sections[c][1] == "main" for c in inside[s])}
    poor = {s for s in size if sections[s][2] < 0 or s in suspects and s not in exempt}
    own = None
    for s in sorted(set(suspects) - exempt, key=lambda x: (-size[x], x)):
        if own is None:  # text by the innermost boilerplate it lies in
            own = {}
            for text, _, section, _ in blocks:
                at = next((c for c in reversed(path_of(section)) if c in poor), None)
                own[at] = own.get(at, 0) + len(text)
        # Text counts unless it lies in boilerplate that neither holds this section nor lies in it.
        rest = size[s] + own.get(None, 0) + sum(own.get(c, 0) for c in around[s] if c in poor)
        if 2 * size[s] <= rest:
            continue
        beside = any(c not in inside[s] and not any(x in poor and x not in around[s] for x in (*around[c], c)) if c not in around[s] else size[s] < 0.9 * size[c] for c in central)
        if not beside:
            exempt.add(s)
            poor.discard(s)
            own = None
    return exempt


def weights_of(blocks: list[tuple], sections: list[tuple]) -> list[float]:
    """The context weight of each section, by its number.

    ``blocks`` are (text, links, section, tag); ``sections`` has parent, name, weight without marks, marked and central (main,
    article or the like) of each, parents first. A mark says nothing about a body, main or article, nor about
    a section with the page's main text in it.
    """
    size = [0] * len(sections)
    for text, _, section, _ in blocks:
        size[section] += len(text)
    for s in range(len(sections) - 1, 0, -1):
        size[sections[s][0]] += size[s]
    suspects = [s for s in range(1, len(sections)) if size[s] and sections[s][3] and sections[s][1] not in ("body", "main", "article")]
    exempt = _exempt(blocks, sections, suspects) if suspects else set()
    out = [0.0] * len(sections)
    for s in range(1, len(sections)):
        parent, name, plain, bad, _ = sections[s]
        mine = -8.0 if bad and name not in ("body", "main", "article") and s not in exempt else plain
        # A bad section keeps its hold on what it contains; a good one does not redeem it.
        out[s] = min(out[parent], mine) if out[parent] < 0 or mine < 0 else max(out[parent], mine)
    return out


def blocks_of(page: str) -> tuple[list[tuple[str, float, float, int, str]], list[int]]:
    """(text, share of link characters, context weight, section, tag) of every block with text, and the parent of each section."""
    out = []
    stack = [("", 0)]  # tag, section
    standing: Counter = Counter()  # tags on the stack
    sections = [(0, "", 0.0, False, False)]  # of each section: parent, name, weight without marks, marked, central
    pieces: list[str] = []
    in_link = linked = at = 0
    tag = ""

    def flush():
        nonlocal linked
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            out.append((text, min(1.0, linked / len(text)), stack[-1][1], tag))
        pieces.clear()
        linked = 0

    def pop() -> str:
        name = stack.pop()[0]
        standing[name] -= 1
        return name

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            pieces.append(piece)
            if in_link:
                linked += len(piece)
        at = m.end()
        name = m.group(3)
        if name is None:
            continue
        name = name.lower()
        if name == "a":
            in_link = 0 if m.group(2) else 1
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name not in _BLOCKS:
            continue
        flush()
        if m.group(2):
            if standing[name] > 0:
                while pop() != name:
                    pass
            in_link = 0
        else:
            closes = _CLOSES.get(name)
            if closes and stack[-1][0] in closes:
                pop()
            elif stack[-1][0] == "p":
                pop()
            section = stack[-1][1]
            if name in _SECTIONS:
                own = _BOILER.get(name, 0.0)
                said = " ".join(x or y or z for x, y, z in _ATTRIBUTE.findall(m.group(4) or ""))
                if own == 0.0 and _GOOD.search(said):
                    own = 3.0
                bad = marked(said)
                sections.append((section, name, own, bad, own > 0 and not bad or name in ("main", "article")))
                section = len(sections) - 1
            if name not in _VOID:
                stack.append((name, section))
                standing[name] += 1
        tag = stack[-1][0]
    if at < len(page):
        pieces.append(page[at:])
    flush()
    weights = weights_of(out, sections)
    return [(text, links, weights[section], section, tag) for text, links, section, tag in out], [s[0] for s in sections]


def log_odds(text: str, links: float, context: float, tag: str) -> float:
    """The classifier: log-odds of a block being content."""
    words = text.count(" ") + 1
    z = context - 4.0 * links + 0.5 * math.log(words) - 1.0
    if tag in ("p", "pre", "blockquote"):
        z += 1.0
    elif tag in ("li", "td", "th", "option", "legend", "summary") and words < 6:
        z -= 1.0
    if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        z += 1.0
    return z


def source_side(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source in the minimum cut. ``gain`` > 0 is capacity from the source, < 0 to the sink.

    Blocking flows along shortest paths: few rounds on a page, each about as long as its number of edges.
    """
    n = len(gain)
    source, sink = n, n + 1
    ends: list[int] = []  # of each arc; arc k ^ 1 is the way back
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def tie(a, b, forth, back):
        out[a].append(len(ends))
        out[b].append(len(ends) + 1)
        ends.extend((b, a))
        room.extend((forth, back))

    for i, g in enumerate(gain):
        if g > 0:
            tie(source, i, g, 0.0)
        elif g < 0:
            tie(i, sink, -g, 0.0)
    for a, b, w in edges:
        tie(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        line = [source]
        for u in line:
            for k in out[u]:
                if room[k] > 1e-12 and level[ends[k]] < 0:
                    level[ends[k]] = level[u] + 1
                    line.append(ends[k])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        turn = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                flow = min(room[k] for k in path)
                for place, k in enumerate(path):
                    room[k] -= flow
                    room[k ^ 1] += flow
                full = next(place for place, k in enumerate(path) if room[k] <= 1e-12)
                u = ends[path[full] ^ 1]
                del path[full:]
                continue
            while turn[u] < len(out[u]):
                k = out[u][turn[u]]
                if room[k] > 1e-12 and level[ends[k]] == level[u] + 1:
                    break
                turn[u] += 1
            if turn[u] < len(out[u]):
                path.append(k)
                u = ends[k]
            elif path:
                u = ends[path.pop() ^ 1]
                turn[u] += 1
            else:
                break


def main_text(page: str | None) -> str:
    """The main text of one page; empty for null, empty or text-free pages.

    If the cut leaves nothing, as on a page of one short line, the blocks outside boilerplate that are not mostly links stay.
    """
    if not page:
        return ""
    blocks, parent = blocks_of(page)
    if not blocks:
        return ""
    depth = [0] * len(parent)
    for s in range(1, len(parent)):
        depth[s] = depth[parent[s]] + 1
    # Neighbouring blocks of one section that the classifier puts on one side are one node.
    gain, where, node = [], [], []
    for text, links, context, section, tag in blocks:
        z = max(-12.0, min(12.0, log_odds(text, links, context, tag)))
        if gain and where[-1] == section and (gain[-1] > 0) == (z > 0):
            gain[-1] += z
        else:
            gain.append(z)
            where.append(section)
        node.append(len(gain) - 1)
    edges = []
    for i in range(1, len(gain)):
        a, b = where[i - 1], where[i]
        steps = 0  # in the tree of sections, up to where both meet and down again
        while a != b:
            if depth[a] >= depth[b]:
                a = parent[a]
            else:
                b = parent[b]
            steps += 1
        edges.append((i - 1, i, 1.0 / (1 + steps)))
    last: dict[int, int] = {}
    for i, section in enumerate(where):
        if section in last and last[section] < i - 1:
            edges.append((last[section], i, 0.75))  # the same section goes on after something else
        last[section] = i
    keep = source_side(gain, edges)
    if not any(keep):
        return "\n".join(text for text, links, context, _, _ in blocks if context >= 0 and links < 0.5)
    return "\n".join(b[0] for b, n in zip(blocks, node) if keep[n])


def extract(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """``pages`` without the html column, with text and n_chars (code points).

    A null or empty page has an empty text. Repeated rows stay; columns named text or n_chars are replaced; an empty table gives no rows.
    """
    others = [F.col(f"`{c}`") for c in pages.columns if c not in (html_column, "text", "n_chars")]

    @F.pandas_udf("text string, n_chars long")
    def run(html: pd.Series) -> pd.DataFrame:
        texts = [main_text(x) for x in html]
        return pd.DataFrame({"text": texts, "n_chars": np.array([len(t) for t in texts], np.int64)})

    # The other columns stay out of Python: ids beside null ones would lose digits there.
    made = pages.select(F.struct(F.lit(0).alias("_"), *others).alias("row"), run(html_column).alias("made"))
    return made.select(*[F.col("row").getField(c).alias(c) for c in pages.columns if c not in (html_column, "text", "n_chars")], "made.text", "made.n_chars")
