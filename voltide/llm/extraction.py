"""Main text of web pages by two-pass block rules.

A page is cut at block-level tags. Blocks inside regions that never hold the article (menus,
headers, footers, sidebars, forms, adverts, notices, comments) are bad from the start. In the first
pass the others are classified by length, link density and stop-word density as good, bad, short or
near good; in the second the undecided ones take the label of the nearest decided neighbours.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltide.llm.common import annotate

# Frequent function words of English, German, French and Spanish.
STOP = frozenset(
    """the of and to in a is that for it with as was on be by at this are from or an but not which have has had
    der die und das in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach bei
    le la les de des du et en un une est que qui dans pour pas sur au par avec ce il plus ne se sont aux ou mais
    el los las del y que una por con para su al lo como más pero sus no se es""".split()
)
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
DROPPED = frozenset("script style noscript template svg math iframe object canvas head title textarea select button nav footer aside form menu dialog".split())
RAW = frozenset("script style textarea title noscript iframe template svg".split())
RAW_END = {t: re.compile(f"</{t}\\s*>", re.I) for t in RAW}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BAD_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|adsense|banner|sponsor(?:ed)?|promo(?:tion)?|nav(?:bar|igation)?|menu|breadcrumbs?|sidebar|side|footer|foot|masthead|topbar|toolbar|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|comments?|commentlist|replies|respond|disqus|widget|tags|pagination|pager|skip|copyright|legal)(?:$|[\s_-])",
    re.I,
)
BAD_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
NAME = re.compile(r"(/?)([a-zA-Z][\w:-]*)")
STOPS = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"([\w:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: A tag that opens while one of these is open ends it.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LETTERS = re.compile(r"[^\W\d_]+")
#: Letters beyond the Latin blocks, and those of which one says as much as three Latin ones.
OTHER = re.compile(r"[\u0370-\u1dff\u1f00-\u1fff\u2c00-\uabff\uac00-\ud7ff\uf900-\ufaff\U00010000-\U0003ffff]")
DENSE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]")


def _dropped(tag: str, attributes: str, inside_article: bool) -> bool:
    if tag in DROPPED or (tag == "header" and not inside_article):
        return True
    if not attributes:
        return False
    a = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "")):
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    return a.get("role", "").lower() in BAD_ROLE or bool(BAD_NAME.search(f"{a.get('class', '')} {a.get('id', '')}"))


def _tag_end(page: str, at: int) -> int:
    """The place of the `>` that ends the tag whose attributes start at `at`, or -1. A quote that is
    never closed is an ordinary character."""
    while m := STOPS.search(page, at):
        if m[0] == ">":
            return m.start()
        close = page.find(m[0], m.end())
        at = close + 1 if close >= 0 else m.end()
    return -1


def _tokens(page: str):
    """(slash, tag, attributes, text) in page order, in one forward scan: a comment, declaration or
    tag that is never ended takes the rest of the page."""
    at, n = 0, len(page)
    while at < n:
        if page[at] != "<":
            end = page.find("<", at)
            end = n if end < 0 else end
            yield "", "", "", page[at:end]
            at = end
            continue
        name = NAME.match(page, at + 1)
        if name:
            end = _tag_end(page, name.end())
            if end < 0:
                return
            tag, attributes = name[2].lower(), page[name.end() : end]
            yield name[1], tag, attributes, ""
            at = end + 1
            if tag in RAW and not name[1] and not attributes.rstrip().endswith("/"):  # no markup inside
                close = RAW_END[tag].search(page, at)
                at = close.end() if close else n
        elif page.startswith(("<!", "<?"), at):
            mark = "-->" if page.startswith("<!--", at) else "]]>" if page.startswith("<![CDATA[", at) else ">"
            end = page.find(mark, at + 2)
            if end < 0:
                return
            at = end + len(mark)
        else:
            yield "", "", "", "<"
            at += 1


def blocks(page: str) -> list[tuple[str, int, bool, bool]]:
    """Text, characters in links, heading and inside an article element, of every kept block. The
    work is in proportion to the page's length, whatever it holds."""
    out: list[tuple[str, int, bool, bool]] = []
    stack: list[tuple[str, bool]] = []  # open tags; whether each drops what it holds
    opened: Counter[str] = Counter()
    drops = linked = articles = 0
    parts: list[str] = []
    in_link = heading = False

    def end() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, linked, heading, articles > 0))
        parts.clear()
        linked = 0

    def pop() -> str:
        nonlocal drops, articles
        tag, bad = stack.pop()
        opened[tag] -= 1
        drops -= bad
        articles -= tag in ("article", "main")
        return tag

    for slash, tag, attributes, text in _tokens(page):
        if not tag:
            if not drops:
                text = entities.unescape(text)
                parts.append(text)
                linked += len(text.strip()) if in_link else 0
            continue
        if tag in BLOCKS:
            end()
        if slash:
            in_link = in_link and tag != "a"
            if opened[tag]:
                while pop() != tag:
                    pass
            heading = heading and tag not in HEADINGS
            continue
        if tag == "br" and not drops:
            parts.append(" ")
        if tag in VOID:
            continue
        while stack and stack[-1][0] in CLOSES.get(tag, ()):
            pop()
        if tag in BLOCKS and tag != "p":  # a paragraph cannot hold another block
            while stack and stack[-1][0] == "p":
                pop()
        in_link = in_link or tag == "a"
        heading = tag in HEADINGS if tag in BLOCKS else heading
        if tag in RAW or (attributes.rstrip().endswith("/") and tag not in BLOCKS):
            continue
        bad = _dropped(tag, attributes, articles > 0)
        stack.append((tag, bad))
        opened[tag] += 1
        drops += bad
        articles += tag in ("article", "main")
    end()
    return out


@lru_cache(maxsize=1024)  # both passes over a page's blocks ask
def stop_words(text: str) -> tuple[int, int] | None:
    """The numbers of stop words and of words; None where most letters are of a script without a list."""
    words = LETTERS.findall(text.lower())
    if max(text, default="") >= "\u0370":
        letters = "".join(words)
        if 2 * len(OTHER.findall(letters)) > len(letters):
            return None
    return sum(w in STOP for w in words), len(words)


def listed(found: list[tuple[str, int, bool, bool]], short: int = 70, low: float = 0.1, links: float = 0.3) -> float | None:
    """The share of stop words in the page's long blocks of scripts that have a list, or None where
    it is so low that no list fits the page's language."""
    counts = [c for text, linked, _, _ in found if len(text) >= short and linked <= links * len(text) and (c := stop_words(text))]
    share = sum(c[0] for c in counts) / max(sum(c[1] for c in counts), 1)
    return share if share >= low else None


def first_pass(text: str, linked: int, short: int = 70, long: int = 200, low: float = 0.1, high: float = 0.2, links: float = 0.3, usual: float | None = 0.3, inside: bool = False) -> str:
    """`usual` is the page's share of stop words; where no list fits (None), length and link density
    decide. A block with few stop words is undecided if so few words have none with a probability of
    0.001 or more at the usual share, or if it is long and not without any; else it is bad. `inside` a
    marked article length decides nothing more, and only a block without any stop word can be bad."""
    density = linked / max(len(text), 1)
    if density > links:
        return "bad"
    size = len(text) + (2 * len(DENSE.findall(text)) if max(text, default="") >= "\u3040" else 0)
    if size < short:
        return "bad" if not inside and linked and density > links / 2 else "short"
    counts = None if usual is None else stop_words(text)
    stop = counts[0] / max(counts[1], 1) if counts else None
    if stop is None or stop >= high:
        return "good" if inside or size > long else "near"
    if stop >= low or (stop > 0 if inside else size > long and stop > low / 2):
        return "near"
    if (1 - usual) ** counts[1] >= 0.001:  # too few words to tell
        return "near" if inside else "short"
    return "bad"


def second_pass(labels: list[str], edge: str = "") -> list[bool]:
    """Undecided blocks take the label of the nearest decided block before and after: good if both
    are, or if it is near good and one is. `edge` is the label beyond the first and the last block; if
    it has none, the other side's counts."""
    n = len(labels)
    before, after = ["" for _ in labels], ["" for _ in labels]
    for order, side in ((range(n), before), (range(n - 1, -1, -1), after)):
        last = edge
        for i in order:
            side[i] = last
            last = labels[i] if labels[i] in ("good", "bad") else last
    keep = []
    for x, b, a in zip(labels, before, after, strict=True):
        if x in ("good", "bad"):
            keep.append(x == "good")
        else:
            near = {s for s in (b, a) if s}
            keep.append("good" in near if x == "near" or len(near) < 2 else near == {"good"})
            if not near:
                keep[-1] = x == "near"
    return keep


def main_text(page: str | None) -> str:
    """The kept blocks in page order, joined by an empty line.

    Where a page marks its article, only blocks inside take part, and the mark speaks for the
    undecided ones: what lies beyond the first and the last block counts as good.
    """
    found = blocks(page or "")
    marked = [b for b in found if b[3]]
    found = marked or found
    usual = listed(found)
    labels = [first_pass(text, linked, usual=usual, inside=bool(marked)) for text, linked, _, _ in found]
    if not marked and "good" not in labels:  # near good is then the best there is
        labels = ["good" if x == "near" else x for x in labels]
        if "good" not in labels:
            return ""
    keep = second_pass(labels, "good" if marked else "")
    return "\n\n".join(b[0] for b, k in zip(found, keep, strict=True) if k)


KIND = T.StructType([T.StructField("text", T.StringType())])


def extract(pages: DataFrame, html: str = "html") -> tuple[DataFrame, str]:
    """Add a struct column (text); returns the frame and that column's name.

    A null or empty page, or one without main text, gives an empty text. Pages are read whole, tags
    left open or never closed included; all columns and rows stay.
    """
    return annotate(pages, html, KIND, lambda: lambda texts: {"text": [main_text(t) for t in texts]})


def main_texts(pages: DataFrame) -> DataFrame:
    df, name = extract(pages.select("page_id", "url", "html"))
    text = F.col(f"{name}.text")
    return df.select("page_id", "url", text.alias("text"), F.char_length(text).cast("long").alias("n_chars"))
