"""Main text of web pages by consensus host paths.

Each page's containers are scored by the share of its wanted text that they
hold; every page votes, in Spark, for the generalised tag-class path of the
deepest container that leaves out next to nothing; pages are then read again
along the path that won on their host, or along their own where that would
leave out text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.common import written

#: Characters of host paths that are broadcast, and where there are more, the
#: number of hosts whose paths are.
BROADCAST_CHARS, HOT = 16_000_000, 2000

#: Comments, and elements whose content is no markup; left open, such an
#: element ends where the page does, as browsers have it.  Declarations.
_SKIPPED = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style|textarea|title|xmp|noembed|noframes)(?=[\s/>])(?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>")
#: A quote opens a value only after an equals sign.
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>")
_NAMED = re.compile(r"(?i)(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
_VALUES = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)")
_HIDDEN = re.compile(r"(?i)aria-hidden\s*=\s*[\"']?true|style\s*=\s*(?:\"[^\"]*|'[^']*)display\s*:\s*none")

#: Tags that make containers, tags that make a block of text,
#: tags without content, tags never in the main text, and words of class, id or
#: role that mark what isn't.
CONTAINERS = frozenset("html body main article section div header footer nav aside form ul ol dl table thead tbody tfoot tr figure details fieldset center menu dialog search hgroup".split())
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th caption figcaption address summary legend hr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNWANTED_TAGS = frozenset("head nav footer aside form menu dialog search noscript template iframe svg math select button object canvas audio video".split())
#: Words that mark a part as unwanted wherever they stand in a name; words that
#: do in a name of such words and of those that may go with them alone, where
#: the part isn't most of the page and no article or main lies in it; words
#: before a name that say the part only has such another.
SURELY = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo breadcrumb breadcrumbs cookie cookies consent gdpr popup modal newsletter subscribe signup login comment comments respond disqus pagination pager navbar navigation sharing".split())
PERHAPS = frozenset("banner promotion nav menu header masthead footer sidebar aside widget notice notices alert overlay share social related recommended replies reply discussion complementary contentinfo search".split())
BESIDE = frozenset("site page top bottom left right main global primary secondary box bar block list item items links link posts articles stories section area container wrap inner outer row col column buttons button icons icon group panel widget widgets text body title form the of and".split())
ONLY_HAS = frozenset("has with no without is not hide show".split())
KEEPS = frozenset("wrapper content article post entry story".split())
#: Parts that an article has of its own and that are wanted.
OWN = frozenset("header masthead banner".split())
MAIN_WORDS = frozenset("article content main post entry story body text".split())
_ENDS_P = CONTAINERS | BLOCKS
_INLINE_BAD = UNWANTED_TAGS - CONTAINERS
#: Share of a page's wanted text that its main container must hold, any or one
#: tagged article or main.
SHARE, TAGGED_SHARE = 0.9, 0.6


def _words(name: str) -> list[str]:
    return [w for w in re.split(r"[^a-z]+", name.lower()) if w]


def marked(names: list[str]) -> int:
    """What a class, id or role says of a part: 3 that it is surely unwanted,
    as its words are all of those that say so or go with them; 2 that it is
    unless it holds the page, as other words stand beside; 1 that it perhaps
    is; 0 nothing.  A name that begins with or says before that it has, hides
    or does without such a part isn't one.  Of names with KEEPS words only the
    last word counts, so that a post's navigation is one and a comment's post
    or a post's header isn't."""
    most = 0
    for name in names:
        words = _words(name)
        told = [k for k, w in enumerate(words) if w in SURELY or w in PERHAPS]
        if not told or not ONLY_HAS.isdisjoint(words[: told[-1]]):
            continue
        if KEEPS.intersection(words) and not {"comment", "comments"}.intersection(words):
            if told[-1] < len(words) - 1 or words[-1] in OWN:
                continue
            most = max(most, 2 if words[-1] in SURELY else 1)
        elif SURELY.intersection(words):
            most = max(most, 3 if all(w in SURELY or w in PERHAPS or w in BESIDE or w in KEEPS for w in words) else 2)
        elif all(w in PERHAPS or w in BESIDE for w in words):
            most = max(most, 1)
    return most


def blocks(page: str) -> list[tuple[str, str, int, bool]]:
    """The blocks of a page in order: path of the containers around it, from
    the page itself (*), text, characters inside links, and whether it lies in an unwanted part."""
    out: list[tuple[str, str, int, bool, tuple[int, ...]]] = []
    stack: list[tuple[str, str, bool, int]] = []  # tag, generalised name, unwanted, number of a part that perhaps is
    text: list[str] = []
    linked, in_link, parts = 0, 0, 0
    main_in: set[int] = set()  # parts that hold an article or main
    head_in: set[int] = set()  # parts that hold a first heading
    mixed: set[int] = set()  # parts that other words than unwanted ones name too

    def flush() -> None:
        nonlocal linked
        if text:
            said = " ".join(html.unescape("".join(text)).split())
            if said:
                path = "/".join(["*", *(name for tag, name, _, _ in stack if tag in CONTAINERS)])
                out.append((path, said, min(linked, len(said)), any(bad for _, _, bad, _ in stack), tuple(part for _, _, _, part in stack if part)))
            text.clear()
        linked = 0

    def close(tag: str) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == tag:
                del stack[k:]
                return
            if tag not in CONTAINERS and stack[k][0] in CONTAINERS:
                return  # what is left open ends with its container

    at = 0
    page = _SKIPPED.sub(" ", page)
    for m in _TAG.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
            if in_link:
                linked += m.start() - at
        at = m.end()
        tag, ending = m[2].lower(), bool(m[1])
        if tag == "a":
            in_link = 0 if ending else 1
        elif tag == "br":
            text.append(" ")
        elif tag in _ENDS_P or tag in _INLINE_BAD:
            flush()
            if ending:
                close(tag)
                continue
            if stack and stack[-1][0] == "p":
                stack.pop()
            if tag in ("li", "dt", "dd", "td", "th", "tr"):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag or tag in ("dt", "dd") and stack[k][0] in ("dt", "dd"):
                        del stack[k:]
                        break
                    if stack[k][0] in ("ul", "ol", "dl", "table", "div", "section", "article"):
                        break
            if tag in VOID or m[3].endswith("/") and tag in _INLINE_BAD:
                continue
            said = [(a.lower(), x or y or z) for a, x, y, z in _NAMED.findall(m[3])]
            inside = any(t in ("article", "main") for t, _, _, _ in stack)
            hidden = bool(_HIDDEN.search(m[3])) or "hidden" in _VALUES.sub(" ", m[3]).lower().split()
            bad, part = tag in UNWANTED_TAGS or hidden, 0
            if tag in ("article", "main"):
                main_in.update(p for _, _, _, p in stack if p)
            elif tag not in ("html", "body"):
                mark = marked([w for a, v in said for w in (v.split() if a == "class" else [v])])
                bad = bad or mark == 3
                if not bad and (mark or tag == "header" and not inside):
                    parts += 1
                    part = parts
                    if mark == 2:
                        mixed.add(part)
            if tag == "h1":
                head_in.update(p for _, _, _, p in stack if p)
            name = ".".join([tag, *sorted({re.sub(r"\d+", "0", w) for a, v in said if a == "class" for w in v.lower().split()})])
            stack.append((tag, name, bad, part))
    text.append(page[at:])
    flush()
    held: dict[int, int] = {}
    for _, said, linked, bad, inside in out:
        for part in inside:
            held[part] = held.get(part, 0) + (0 if bad else len(said) - linked)
    whole = sum(len(said) - linked for _, said, linked, bad, _ in out if not bad)
    kept = main_in - mixed | {part for part, n in held.items() if (10 * n > 9 * whole or part in head_in and 2 * n > whole if part in mixed else 2 * n > whole)}
    return [(path, said, linked, bad or any(part not in kept for part in inside)) for path, said, linked, bad, inside in out]


def scores(found: list[tuple[str, str, int, bool]]) -> dict[str, float]:
    """Share of a page's wanted text outside links that each container path
    holds, its child containers' included."""
    points: dict[str, float] = {}
    whole = 0.0
    for path, said, linked, bad in found:
        worth = 0 if bad else max(len(said) - 2 * linked, 1)
        if worth:
            whole += worth
            at = len(path)
            while at > 0:
                points[path[:at]] = points.get(path[:at], 0.0) + worth
                at = path.rfind("/", 0, at)
    return {path: x / whole for path, x in points.items()}


def own_path(points: dict[str, float]) -> str | None:
    """Where an article or main holds most of the page's wanted text, the one
    that holds most of it; else the deepest container that leaves out next to
    nothing, those named as main first."""
    step = lambda path: path.rpartition("/")[2].split(".")
    tagged = [p for p, x in points.items() if step(p)[0] in ("article", "main") and x >= TAGGED_SHARE]
    if tagged:
        return max(tagged, key=lambda p: (points[p], p.count("/"), p))
    named = lambda path: any(not MAIN_WORDS.isdisjoint(_words(c)) for c in step(path)[1:])
    return max((p for p, x in points.items() if x >= SHARE), key=lambda p: (named(p), p.count("/"), points[p], p), default=None)


def main_text(found: list[tuple[str, str, int, bool]], path: str) -> str:
    """The wanted blocks, joined by an empty line: all at or below a path, and
    those elsewhere that aren't mostly links, as headlines and parts of an
    article stand beside its main container too."""
    return "\n\n".join(said for at, said, linked, bad in found if not bad and (at == path or at.startswith(path + "/") or 2 * linked < len(said)))


def _votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        votes: dict[tuple[str, str], float] = {}
        for host, page in zip(batch["host"], batch["html"], strict=True):
            points = scores(blocks(page or ""))
            if (path := own_path(points)) is not None:
                votes[host, path] = votes.get((host, path), 0.0) + points[path]
        yield pd.DataFrame([(h, p, v) for (h, p), v in votes.items()], columns=["host", "path", "votes"]).astype({"host": object, "path": object, "votes": float})


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, paths = [], []
        for page, path in zip(batch.column("html"), batch.column("path").to_pylist(), strict=True):
            found = blocks(page.as_py() or "")
            points = scores(found)
            own = own_path(points)
            if own is not None and (path is None or points.get(path, 0.0) < min(SHARE, points[own])):
                path = own  # a page built otherwise than its host's others
            text = main_text(found, path) if own is not None else ""
            texts.append(text)
            paths.append(path if own is not None else None)
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(paths, pa.string())], names=["page_id", "url", "text", "main_path"])


def host_paths(pages: DataFrame) -> DataFrame:
    """``host, path, votes``: the path that won on each host.  Votes are added
    up in each batch and task before they are moved."""
    votes = pages.select("host", "html").mapInPandas(_votes, "host string, path string, votes double")
    summed = votes.groupBy("host", "path").agg(F.sum(F.round("votes", 6)).alias("votes"))
    best = summed.groupBy("host").agg(F.max(F.struct(F.round("votes", 3).alias("votes"), "path")).alias("best"))
    return best.select("host", "best.path", "best.votes")


def _with_paths(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """Rows with the path of their host.  Pages stay where they are: paths go
    to them, all if they are few and short, else those of the hosts of most
    votes, and pages of other hosts, each with few, meet theirs in a join."""
    n, longest = paths.agg(F.count("*"), F.max(F.length("path") + F.length("host"))).first()
    few = n * (longest or 0) <= BROADCAST_CHARS
    paths = paths.select("host", "path", "votes")
    hot = paths if few else paths.where(F.length("path") + F.length("host") <= 2000).orderBy(F.desc("votes"), "host").limit(HOT)
    both = rows.join(F.broadcast(hot.select("host", "path")), "host", "left")
    if few:
        return both
    others = paths.join(F.broadcast(hot.select("host")), "host", "left_anti").select("host", "path")
    return both.where("path IS NOT NULL").unionByName(both.where("path IS NULL").drop("path").join(others, "host", "left"))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars, main_path`` for each row of pages.

    A block's character references are decoded, its white space becomes one
    space, its ends are trimmed; blocks in page order are joined by an empty
    line.

    Defined results: a null or empty html, or one without wanted text, gives
    the empty text; pages of a null url or one without a host vote together;
    repeated rows give repeated results; markup left open is closed where its
    parent ends; parts are unwanted by tag or by the words of their class, id
    or role (see SURELY and PERHAPS); an empty table gives no rows; other columns are not looked
    at."""
    host = F.lower(F.regexp_extract(F.coalesce(url_col, F.lit("")), r"://(?:www\.|m\.)?([^/?#:]*)", 1))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    chosen = _with_paths(rows, written(host_paths(rows), "host-paths"))
    out = chosen.select("page_id", "url", "html", "path").mapInArrow(_extracted, "page_id bigint, url string, text string, main_path string")
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), "main_path")
