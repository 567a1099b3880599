"""Main text of web pages by line-block distribution.

Markup is stripped into lines (one per block element).  Lines of menus, adverts, forms and the like carry no
text; over the rest the text lengths of sliding windows of ``WINDOW`` lines are summed.  The text
surges where that sum rises from nothing and dives where it falls back to nothing; what lies
between a surge and its dive is kept.  A page that marks its article is cut to it first; on
any other page a stretch has to reach ``SURGE`` characters and a share of the longest stretch, unless it
stands in the same container: of such a stretch the lines in the container are kept whatever their size.

What an element is called parts it off only where the whole class or id is the name of a menu, an advert, comments and so on.
A word of that kind inside a longer name raises a suspicion, which the lines decide: links and lines without a surge go.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a window.
WINDOW = 3
#: Without a marked article: least characters of a window where text surges, and least share of the longest stretch.
SURGE, LEAST_SHARE = 80, 0.25
#: A line is a menu entry if this share of its text is inside links.
LINK_SHARE = 0.7

#: Elements that never hold article text.
SKIPPED = frozenset("""head title script style noscript template nav footer aside form button select option optgroup
textarea fieldset iframe svg canvas object embed video audio map dialog menu datalist""".split())
#: Elements that end a line.
BLOCKS = frozenset("""html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody
tfoot tr blockquote pre figure figcaption address hr details summary center header hgroup""".split())
#: Elements that hold a part of a page of their own; sections and the like divide one text.
CONTAINERS = frozenset("body div td th center".split())
#: Elements whose name may raise a suspicion about all they hold.
HOLDING = frozenset("div section ul ol dl table td th center details aside".split())
SPACES = frozenset("br td th wbr img input".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Words that, as a whole class or id, name a part beside the article.
OWNERS = frozenset("""ad ads advert adverts advertisement advertisements advertising adsense adslot adsbygoogle banner sponsor
sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup
sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs footer comment comments commentlist disqus
pagination pager toolbar login masthead topbar""".split())
#: Words that raise a suspicion, which the lines of the part decide.
SUSPECTS = OWNERS | frozenset("""alert reply replies respond discussion related recommended recommendations teaser teasers share
sharing social search copyright legal disclaimer contentinfo complementary header""".split())
#: Words that only say which piece of a part it is, and ones that name what holds the article.
PIECES = frozenset("""box section list wrapper wrap container area block inner content left right top bottom main item slot unit bar
form header body text title links site page post article entry primary secondary global sticky fixed mobile desktop""".split())
HOLDERS = frozenset("content post article entry story main text page container wrapper layout body".split())
ROLES = frozenset("navigation search complementary contentinfo dialog alertdialog menu menubar toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose end tag may be left out: what holds them, and the tags of which one that opens ends them.
_ROWS = frozenset("tr thead tbody tfoot".split())
_IMPLIED = {"li": (frozenset(("ul", "ol", "menu")), frozenset(("li",))), "dt": (frozenset(("dl",)), frozenset(("dt", "dd"))),
            "dd": (frozenset(("dl",)), frozenset(("dt", "dd"))), "td": (frozenset(("table",)), _ROWS | {"td", "th"}),
            "th": (frozenset(("table",)), _ROWS | {"td", "th"}), "tr": (frozenset(("table",)), _ROWS)}
_RAW = "script|style|noscript|template|textarea|title|iframe|svg"
_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>"""
    r"""|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>"']++|"[^"]*"|'[^']*')*+)>"""
    r"""|<(?P<close2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*)[^<>]*>""", re.S | re.I)
_NAMES = re.compile(r"""\b(?P<name>class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_TALK = re.compile(r"comment|repl(?:y|ies)|disqus|discussion", re.I)
_MAIN = re.compile(r"""\brole\s*=\s*["']?main\b""", re.I)


def _names_part(name: str) -> bool:
    """Whether a whole class or id names a part beside the article: an owner's word, alone or with words that say which
    piece of it is meant."""
    words = [w for w in re.split(r"[-_]+", name) if w and not w.isdigit()]
    return not OWNERS.isdisjoint(words) and all(w in SUSPECTS or w in PIECES for w in words)


def _beside(tag: str, attrs: str, in_article: bool) -> int:
    """Whether an element opens a part that is not the article: 2 certainly, 1 perhaps, 0 no."""
    if tag in SKIPPED or (tag == "header" and not in_article):
        return 2
    if not attrs or tag in ("html", "body") or _MAIN.search(attrs):
        return 0
    if _HIDDEN.search(attrs):
        return 2
    named = [(m["name"].lower(), (m[2] or m[3] or m[4] or "").lower().split()) for m in _NAMES.finditer(attrs)]
    if any(name == "role" and not ROLES.isdisjoint(values) for name, values in named):
        return 2
    # the id of a heading or a phrase is what links to it name
    tokens = [v for name, values in named for v in values if name == "class" or (name == "id" and tag in BLOCKS and tag not in HEADINGS)]
    if tag in ("article", "main"):
        return 2 if any(re.match(r"(comment|reply)s?\b", v) for v in tokens) else 0
    holds = any(v in HOLDERS for v in tokens)
    if any(map(_names_part, tokens)):
        return 1 if holds else 2
    if not in_article and not holds and any(re.fullmatch(r"(?:(?:site|page|top|main|global)[-_])?header", v) for v in tokens):
        return 2
    return int(tag in HOLDING and any(not SUSPECTS.isdisjoint(re.split(r"[^a-z0-9]+", v)) for v in tokens))


def _implied_end(skip: str, tag: str, closing: bool, held: int) -> bool:
    """Whether a tag ends the element ``skip`` that has no end tag; ``held``: lists or tables open inside it."""
    if skip == "p":
        return tag != "p" and tag in BLOCKS if closing else tag in BLOCKS or tag in ("nav", "aside", "footer", "form", "menu", "fieldset")
    holders, siblings = _IMPLIED[skip]
    return held == 0 and (tag in holders or (skip[0] == "t" and skip != tag and tag in _ROWS) if closing else tag in siblings)


def lines_of(page: str) -> list[tuple[str, int, bool, int, int]]:
    """(text, characters inside links, inside a marked article, number of the container, number of the suspicious part or 0)
    of every line; skipped parts give empty lines."""
    lines: list[tuple[str, int, bool, int, int]] = []
    suspects: list[list] = []  # tags of the open suspicious parts, how often each is nested, the number of the outermost
    n_suspects = articles = inner = 0  # articles begun; ones open inside the part that is skipped
    holders: list[tuple[str, int]] = [("", 0)]  # the open containers and their numbers
    n_holders = 0
    parts: list[str] = []
    linked = link_depth = article = 0
    mains: list[list] = []  # tags that carry the role of the main part, and how often each is nested
    talk = False
    skip, depth, held = "", 0, 0  # the element being skipped, how often it is nested, and the lists or tables in it

    def end() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            lines.append((text, linked, article > 0, holders[-1][1], suspects[-1][2] if suspects else 0))
        parts.clear()
        linked = 0

    def text(raw: str) -> None:
        nonlocal linked
        if not skip and raw:
            out = html.unescape(raw)
            parts.append(out)
            if link_depth:
                linked += len("".join(out.split()))

    at = 0
    for m in _TOKEN.finditer(page):
        text(page[at:m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            if m["raw"] and not skip and m["raw"].lower() in ("textarea", "title"):
                end()
            continue
        closing = bool(m["close"] or m["close2"])
        marked = tag in ("article", "main") or bool(m["attrs"] and _MAIN.search(m["attrs"]))
        if skip:
            implied = (skip == "p" or skip in _IMPLIED) and _implied_end(skip, tag, closing, held)
            if not implied and skip in _IMPLIED and tag in _IMPLIED[skip][0]:
                held += -1 if closing else 1
            elif not implied and tag == skip and not (held and skip in _IMPLIED):
                depth += -1 if closing else 0 if (m["attrs"] or "").endswith("/") else 1
            # an unclosed part ends where the page's article begins or what holds it ends; not at articles of its own
            begins = marked and not closing and not articles and not talk and not _beside(tag, m["attrs"] or "", False)
            own = closing and tag == "article" and inner > 0
            inner += (tag == "article" and not closing and not begins) - own
            if depth and not implied and not begins and (own or not (closing and tag in ("article", "main", "body", "html"))):
                continue
            ended, skip, depth = depth == 0, "", 0
            lines.append(("", 0, article > 0, holders[-1][1], suspects[-1][2] if suspects else 0))
            if ended:
                continue
        beside = 0 if closing or tag in VOID else _beside(tag, m["attrs"] or "", article > 0)
        if beside == 2:
            end()
            if not (m["attrs"] or "").endswith("/"):
                skip, depth, held, inner = tag, 1, 0, 0
                talk = bool(_TALK.search(m["attrs"] or ""))  # comments hold articles of their own
            continue
        if beside and not (m["attrs"] or "").endswith("/"):
            end()
            n_suspects += 1
            suspects.append([tag, 1, suspects[0][2] if suspects else n_suspects])
        elif suspects and tag == suspects[-1][0]:
            suspects[-1][1] += -1 if closing else 1
            if not suspects[-1][1]:
                end()
                suspects.pop()
        if marked and not closing:
            if not articles:
                end()
                suspects.clear()
            articles += 1
        if tag in BLOCKS:
            end()
        elif tag in SPACES:
            parts.append(" ")
        if tag == "a":
            link_depth = 0 if closing else 1
        if tag in CONTAINERS and not closing:
            n_holders += 1
            holders.append((tag, n_holders))
        elif tag in CONTAINERS:
            at_tag = next((k for k in range(len(holders) - 1, 0, -1) if holders[k][0] == tag), 0)
            if at_tag:
                del holders[at_tag:]
        if mains and tag == mains[-1][0]:
            mains[-1][1] += -1 if closing else 1
            if not mains[-1][1]:
                mains.pop()
                article = max(0, article - 1)
        elif marked:
            article = max(0, article - 1) if closing else article + 1
            if tag not in ("article", "main"):
                mains.append([tag, 1])
    if not skip:
        text(page[at:])
    end()
    return lines


def _refused(lines: list[tuple], marked: bool) -> set[int]:
    """Suspicious parts whose lines are not the article's: mostly links, or, outside a marked article, text that never surges."""
    parts: dict[int, list[tuple[int, int]]] = {}
    for text, linked, _, _, part in lines:
        if part:
            parts.setdefault(part, []).append((len(text.replace(" ", "")), linked))
    out = set()
    for part, sizes in parts.items():
        free = [n - min(n, k) for n, k in sizes]
        loudest = max(sum(free[max(0, i - WINDOW + 1):i + 1]) for i in range(len(free)))
        if sum(free) <= (1 - LINK_SHARE) * sum(n for n, _ in sizes) or (not marked and loudest < SURGE):
            out.add(part)
    return out


def main_text(page: str | None) -> str:
    """Blocks of the main text, joined by two line feeds; empty if there are none."""
    lines = lines_of(page or "")
    marked = any(inside and text for text, _, inside, _, _ in lines)
    refused = _refused(lines, marked)
    whole = [k for k, line in enumerate(lines) if line[4] not in refused]
    # a part that is all there is cannot be beside the article
    if refused and not any(lines[k][0] and (lines[k][2] or not marked) for k in whole):
        refused = set()
    # weight of a line: its text, without entries of menus and without what lies outside the article
    weight = [0 if part in refused else len(text) if (inside if marked else linked < LINK_SHARE * len(text.replace(" ", ""))) else 0
              for text, linked, inside, _, part in lines]
    total = [sum(weight[max(0, i - WINDOW + 1):i + 1]) for i in range(len(weight))]
    stretches, begin = [], None
    for i, w in enumerate([*weight, 0]):
        quiet = i == len(weight) or (total[i] == 0 or (w == 0 and marked and not lines[i][2]))
        if begin is None and not quiet and w:
            begin = i
        elif begin is not None and quiet:
            last = max(k for k in range(begin, i) if weight[k])
            stretches.append((begin, last + 1, sum(weight[begin:i]), max(total[begin:i])))
            begin = None
    kept: list[tuple[int, int, int | None]] = [(a, b, None) for a, b, _, _ in stretches]  # of which container (None: any)
    if not marked and stretches:
        longest = max(s[2] for s in stretches)
        loud = [s for s in stretches if s[3] >= SURGE and s[2] >= LEAST_SHARE * longest]
        loud = loud or [s for s in stretches if s[2] == longest][:1]
        first, last = next(s[:2] for s in stretches if s[2] == longest)
        held: dict[int, int] = {}
        for k in range(first, last):
            held[lines[k][3]] = held.get(lines[k][3], 0) + weight[k]
        most = max(held, key=lambda c: held[c])
        kept = [(s[0], s[1], None if s in loud else most) for s in stretches]
    return "\n\n".join(lines[k][0] for a, b, within in kept for k in range(a, b)
                       if lines[k][0] and lines[k][4] not in refused and (not marked or lines[k][2])
                       and (within is None or (lines[k][3] == within and weight[k])))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` of every row of ``pages`` (``page_id``, ``url``, ``html``).

    A null or empty page has an empty text.  Null ids and urls, repeated rows and extra
    columns do no harm: a row in, a row out, of these columns."""
    @F.pandas_udf("string")
    def extracted(pages: pd.Series) -> pd.Series:
        return pages.map(main_text)

    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return rows.select("page_id", "url", extracted("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
