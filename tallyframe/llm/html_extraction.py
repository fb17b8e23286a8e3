"""Main text of pages by union-free wrappers that same-host pages are aligned into.

A page is a stream of blocks, each with the path of elements around it; equal paths in a
row fold into a repeated group. A host's wrapper starts as the stream of one page; every
other page is aligned to it by longest common subsequences: slots that only some pages
have become optional, slots that repeat anywhere become repeated, and each text slot
remembers how often it occurs, how much text and link text it holds and whether all pages
have the same words there. Wrappers align with wrappers in the same way, so every batch
of pages makes wrappers of its own, which meet by host and salt, then by host: a host
with a third of all pages is a handful of small wrappers by then.

The wrapper names the host's main slots: those in the innermost element that holds most
of the text, without navigation, forms, notices and the like, and without slots whose
words are the same on all pages. Pages are then read against their host's wrapper. Where
the wrapper has a slot of links, blocks of its path go if they are links themselves.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import Scratch

SALTS = 32
MAIN_SHARE = 0.6  # of the text that the main element holds
SAME_PAGES = 3  # pages that must agree before words count as the template's
LINK_SHARE = 0.8  # a slot with more of its text in links is a menu

RAW = frozenset(["script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "template"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr img br".split()
)
AWAY = frozenset("head nav header footer aside form button select option menu dialog svg canvas audio video object figure-ad".split())
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
AWAY_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies copyright discussion disqus footer form header login masthead menu modal nav navbar navigation newsletter "
    "notice popup promo promotion related reply replies respond search share sharing sidebar signup social sponsor "
    "sponsored subscribe subscription toolbar topbar widget".split()
)
CLOSES = {  # an element that ends an open one of these, unless one of the second stands between
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
HEAD_ONLY = frozenset("base link meta title style script".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_QUALIFIED = re.compile(r"(?i)\b(?:has|with|without|no|non|hide|is-not)[-_][a-z_-]+|\b[a-z]+[-_]free\b|\blong[-_]?form\b")


def _is_away(name: str, attributes: dict[str, str]) -> bool:
    if name in AWAY or attributes.get("role", "").lower() in AWAY_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if name in ("html", "body", "main", "article"):
        return False
    said = attributes.get("class", "") + " " + attributes.get("id", "")
    said = _QUALIFIED.sub(" ", said)  # "has-sidebar" says what stands beside, not what this is
    return any(w.lower() in AWAY_WORDS for w in _WORD.findall(said))


def blocks_of(page: str) -> Iterator[tuple[str, bool, str, int]]:
    """(path, away, text, characters in links) of the blocks of a page, in order.

    An element that by name or class is not the article, but holds most of the page's text
    and its heading or main element, such as a form around the whole page, counts as any other.
    """
    around: set[int] = set()
    found = list(_blocks(page, around))
    size: dict[int, int] = {}
    for _, away, text, linked in found:
        for k in away:
            size[k] = size.get(k, 0) + len(text) - linked
    whole = sum(len(text) - linked for _, _, text, linked in found)
    kept = {k for k in around if 2 * size.get(k, 0) > whole}
    for path, away, text, linked in found:
        yield path, any(k not in kept for k in away), text, linked


def _blocks(page: str, around: set[int]) -> Iterator[tuple[str, tuple[int, ...], str, int]]:
    """``blocks_of`` with the numbers of the away elements a block stands in; ``around`` gets those that hold a heading or main element.

    Unclosed and unopened tags are met as browsers do: a block element ends an open
    paragraph, an end tag ends all that is open inside its element and counts for nothing
    if its element is not open, and what is open at the end of the page ends there.
    """
    stack: list[tuple[str, str, int]] = []  # name, step of the path, number if away, else 0
    parts: list[str] = []
    in_link = linked = numbered = 0

    def flush() -> Iterator[tuple[str, tuple[int, ...], str, int]]:
        nonlocal parts, linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            yield "/".join(s[1] for s in stack), tuple(s[2] for s in stack if s[2]), text, min(linked, len(text))
        parts, linked = [], 0

    at, end = 0, len(page)
    while at < end:
        tag = _TAG.search(page, at)
        data = page[at : tag.start() if tag else end]
        if data:
            parts.append(data)
            linked += len(data) if in_link else 0
        if not tag:
            break
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            continue
        closing = bool(tag[1] or tag[4])
        if name in INLINE:
            if name == "a":
                in_link = 0 if closing else 1
            elif name == "br":
                parts.append(" ")
            continue
        if closing:
            if any(s[0] == name for s in stack):
                yield from flush()
                while stack.pop()[0] != name:
                    pass
                in_link = 0
            elif name == "p":
                yield from flush()
            continue
        if name in RAW:
            stop = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
            at = stop.end() if stop else end
            if name not in ("script", "style", "noscript", "template"):
                yield from flush()
            continue
        yield from flush()
        if name in VOID:
            continue
        inside = [s[0] for s in stack]
        if "p" in inside:
            del stack[len(inside) - 1 - inside[::-1].index("p") :]
        elif name in CLOSES:
            ends, stops = CLOSES[name]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in stops:
                    break
                if stack[k][0] in ends:
                    del stack[k:]
                    break
        if name == "body" and inside[-1:] == ["head"]:
            stack.pop()
        attributes = {m[0].lower(): html.unescape(m[1] or m[2] or m[3]) for m in _ATTRIBUTE.findall(tag[3] or tag[6] or "")}
        kind = attributes.get("class", "").split()
        step = name + ("." + kind[0] if kind else "") if name not in ("html", "body") else name
        if name in ("h1", "main"):
            around.update(s[2] for s in stack if s[2])
        numbered += 1
        stack.append((name, step, numbered if _is_away(name, attributes) else 0))
        in_link = 0
    yield from flush()


# --- wrappers --------------------------------------------------------------------------
# A wrapper is {"pages": n, "slots": [slot, ...]}, a slot
# {"path", "away", "pages", "most" (repeats in a page), "chars", "links", "same" (words or null)}.


def page_wrapper(blocks: list[tuple[str, bool, str, int]]) -> dict:
    slots: list[dict] = []
    for path, away, text, links in blocks:
        if slots and slots[-1]["path"] == path:
            last = slots[-1]
            last["most"] += 1
            last["chars"] += len(text)
            last["links"] += links
            last["same"] = f"{last['same']}\n{hash_of(text)}" if last["most"] <= 4 else hash_of(last["same"] + text)
        else:
            slots.append({"path": path, "away": away, "pages": 1, "most": 1, "chars": len(text), "links": links, "same": hash_of(text)})
    return {"pages": 1, "slots": slots}


def hash_of(text: str) -> str:
    import xxhash

    return xxhash.xxh3_64_hexdigest(text)


def merged_slot(a: dict, b: dict) -> dict:
    return {
        "path": a["path"], "away": a["away"] or b["away"], "pages": a["pages"] + b["pages"], "most": max(a["most"], b["most"]),
        "chars": a["chars"] + b["chars"], "links": a["links"] + b["links"], "same": a["same"] if a["same"] == b["same"] else None,
    }


def aligned(a: dict, b: dict) -> dict:
    """The wrapper of all pages of both: common slots merge, the others are optional where they stand."""
    x, y = [s["path"] for s in a["slots"]], [s["path"] for s in b["slots"]]
    if x == y:
        return {"pages": a["pages"] + b["pages"], "slots": [merged_slot(s, t) for s, t in zip(a["slots"], b["slots"])]}
    slots: list[dict] = []
    for kind, i, j, k, m in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
        if kind == "equal":
            slots += [merged_slot(s, t) for s, t in zip(a["slots"][i:j], b["slots"][k:m])]
        else:
            slots += [*a["slots"][i:j], *b["slots"][k:m]]
    folded: list[dict] = []  # optional slots of one path in a row are one repeated slot
    for slot in slots:
        if folded and folded[-1]["path"] == slot["path"]:
            last = folded[-1]
            folded[-1] = merged_slot(last, slot) | {"pages": max(last["pages"], slot["pages"]), "most": last["most"] + slot["most"]}
        else:
            folded.append(slot)
    return {"pages": a["pages"] + b["pages"], "slots": folded}


def is_template(slot: dict, pages: int) -> bool:
    """Whether the slot's words belong to the wrapper: the same on all of several pages."""
    return slot["same"] is not None and slot["pages"] >= SAME_PAGES and slot["pages"] == pages


def main_slots(wrapper: dict) -> dict:
    """{"main": the main element's path, "drop": {path: words of its template slots}, "menus": paths that some slot of links has}."""
    weight: dict[str, int] = {}
    drop: dict[str, set[str]] = {}
    menus: set[str] = set()
    for slot in wrapper["slots"]:
        steps = slot["path"].split("/")
        if slot["away"]:
            continue
        if is_template(slot, wrapper["pages"]) and not re.search(r"(^|/)(article|main)\b", slot["path"]):
            drop.setdefault(slot["path"], set()).add(slot["same"])
        elif slot["links"] >= LINK_SHARE * slot["chars"]:
            menus.add(slot["path"])
        else:
            for k in range(len(steps)):
                part = "/".join(steps[: k + 1])
                weight[part] = weight.get(part, 0) + slot["chars"]
    named = [p for p in weight if re.fullmatch(r"(article|main)(\..*)?", p.rsplit("/", 1)[-1])]
    if named:
        main = max(named, key=lambda p: (weight[p], -len(p)))
        if weight[main] >= 0.3 * max(weight.values()):
            return {"main": main, "drop": drop, "menus": menus}
    whole = max(weight.values(), default=0)
    leaf = re.compile(r"/(p|h[1-6]|li|ul|ol|dl|dt|dd|pre|blockquote|table|tbody|tr|td|th|figure|figcaption)(\.[^/]*)?$")
    inner = [p for p, w in weight.items() if w >= MAIN_SHARE * whole and not leaf.search(p)]
    return {"main": max(inner, key=len, default=""), "drop": drop, "menus": menus}


def main_text(page: str | None, wrapper: dict | None) -> str:
    """The text of a page by its host's main slots; by its own wrapper where it fits nothing of the host's."""
    blocks = list(blocks_of(page or ""))
    for known in (wrapper, main_slots(page_wrapper(blocks))):
        if known is None:
            continue
        main, out = known["main"], []
        for path, away, text, links in blocks:
            if away or not (path == main or path.startswith(f"{main}/") or not main):
                continue
            if path in known["menus"] and links >= LINK_SHARE * len(text):
                continue
            if path in known["drop"] and hash_of(text) in known["drop"][path]:
                continue
            out.append(text)
        if out:
            return "\n".join(out)
    return ""


def _host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@]*@)?([^/?#]*)", 1)), F.lit(""))


def _fold(rows: Iterator[dict]) -> dict | None:
    out = None
    for row in rows:
        out = row if out is None else aligned(out, row)
    return out


def _met(pdf: pd.DataFrame) -> pd.DataFrame:
    found = _fold(map(json.loads, sorted(pdf["wrapper"])))
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [json.dumps(found)]})


def host_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) of all pages (host, html)."""

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found: dict[str, dict] = {}
            for host, page in zip(pdf["host"], pdf["html"]):
                one = page_wrapper(list(blocks_of(page or "")))
                found[host] = aligned(found[host], one) if host in found else one
            if found:
                yield pd.DataFrame({"host": list(found), "wrapper": [json.dumps(w) for w in found.values()]})

    rows = pages.mapInPandas(own, "host string, wrapper string")
    salt = F.pmod(F.xxhash64("wrapper"), F.lit(SALTS))
    return rows.groupBy("host", salt).applyInPandas(_met, "host string, wrapper string").groupBy("host").applyInPandas(_met, "host string, wrapper string")


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, text (blocks joined by \\n, empty if none) and n_chars.

    Null html is empty; a null url, or one without a host, belongs to the host "". Ids may
    be null or repeated. Other columns are not read; an empty table gives no rows.
    """
    scratch = Scratch(pages.sparkSession)
    kind = dict(pages.dtypes)[id_col]
    read = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).withColumn("host", _host(F.col("url")))
    wrappers = scratch.keep(host_wrappers(read.select("host", "html")), "wrappers")

    def extracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, dict] = {}
        for pdf in batches:
            texts = []
            for host, page, wrapper in zip(pdf["host"], pdf["html"], pdf["wrapper"]):
                if host not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[host] = main_slots(json.loads(wrapper)) if wrapper else None
                texts.append(main_text(page, known[host]))
            yield pd.DataFrame({"page": pdf["page"], "url": pdf["url"], "text": texts})

    found = read.join(wrappers, "host", "left").mapInPandas(extracted, f"page {kind}, url string, text string")
    return found.select(F.col("page").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
