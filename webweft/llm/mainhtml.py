"""Main text of web pages by two passes over their blocks.

The first pass classifies each block by stop-word density, length and link density, together
with what the markup says of the place. Short or middling blocks stay ambiguous; the second
pass gives them the label of their nearest decided neighbours.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dom.markup import END, START, TEXT, VOID, tokens
from .common import named

#: Frequent function words of the languages that are told from lists of names.
STOP_WORDS = frozenset(
    """a about after all also an and any are as at be because been but by can could did do for from had has have he her his
    how i if in into is it its more my no not of on one or other our out she so some than that the their them then there
    these they this to up was we were what when which who will with would you your
    al como con de del e el ella en era es esta este fue ha hay la las le lo los más me mi muy no nos o para pero por que
    qué se ser si sin sobre son su sus también un una uno y ya
    au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui mais même ne nous on ou où par
    pas plus pour qu que qui sa sans se ses son sont sur tout un une vous été être
    aber als am an auch auf aus bei bin bis das dass dem den der des die doch du durch ein eine einem einen einer er es für
    hat ich ihr im in ist kann mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wenn wer
    werden wie wir zu zum zur
    che di il non per più sono della dei gli nel alla uma os as não em com mais foi het een van niet zijn ook""".split()
)
#: Lengths in characters and densities between which a block is ambiguous.
SHORT, LONG = 70, 200
FEW_STOPS, MANY_STOPS = 0.10, 0.20
LINKED = 0.33
#: Blocks up to so many characters away pass their label on to a heading above them.
NEAR_HEADING = 200
#: So many link-only blocks in a row are a menu wherever they stand.
MENU_ROWS = 3

#: Elements that begin and end a block.
BLOCKS = frozenset(
    """address article aside blockquote body canvas caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p
    pre search section summary table tbody td template tfoot th thead title tr ul""".split()
)
#: Elements whose content is never main text.
NEVER = frozenset(
    """aside audio button canvas datalist dialog fieldset footer form head iframe input label map menu nav noembed
    noframes noscript object script select style svg template textarea title video""".split()
)
REGIONS = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of class and id that name what is not main text.
HINTS = frozenset(
    """ad ads adsbygoogle adv advert adverts advertisement advertising aside banner breadcrumb breadcrumbs comment
    commentlist comments consent cookie cookies disqus footer gdpr hidden login masthead menu menus modal nav navbar
    navigation navigator newsletter notice notices notification overlay pager pagination popup promo promoted promotion
    recommended related replies reply respond search share sharing sidebar signin signup skip social sponsor sponsored
    sponsors subscribe subscription toc toolbar topbar widget""".split()
)
#: Words that may stand beside them in one name and say nothing of their own, as do numbers and single letters.
PLACES = frozenset(
    """area article bar bottom box btn button buttons center col column container content entry fixed form group header icons
    inner item items left link links list main media outer page panel post posts primary right row secondary section site
    sticky tertiary thread top unit wrap wrapper zone slot""".split()
)
#: Those that only count outside an article, where they may as well name parts of it.
OUTER_HINTS = frozenset(("header", "notice", "banner"))

_HINT_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORDS = re.compile(r"[^\W\d_]+")
#: A start tag of a key ends open elements of its values.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

GOOD, BAD, SHORT_BLOCK, MIDDLING = "good", "bad", "short", "middling"


@dataclass
class Block:
    text: str
    linked: int  # characters in links
    heading: bool
    region: bool  # in the article or main part
    barred: bool  # in a part that never holds main text
    label: str = ""
    named: tuple[int, ...] = ()  # start tags around it whose class or id bars it, by number
    hard: bool = False  # barred by more than a class or id


def hidden(attrs: dict[str, str]) -> bool:
    """Whether attributes hide an element or give it a role other than main text."""
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in ROLES:
        return True
    return "style" in attrs and bool(_HIDDEN.search(attrs["style"]))


def hinted(attrs: dict[str, str], inside: bool) -> bool:
    """Whether a name of class or id names something other than main text: all of its words are
    hints or places, and one is a hint. A hint within other words ("tags-explained") is none."""
    hints = HINTS - OUTER_HINTS if inside else HINTS | OUTER_HINTS
    for key in ("class", "id"):
        for name in (attrs.get(key) or "").split():
            words = [w.lower() for w in _HINT_WORDS.findall(name) if len(w) > 1]
            if any(w in hints for w in words) and all(w in hints or w in PLACES for w in words):
                return True
    return False


def blocks(html: str, hints: bool = True, lifted: frozenset[int] = frozenset()) -> list[Block]:
    """Text blocks of a page in order, white space inside each turned into single spaces.

    Without ``hints``, attributes don't bar anything, only elements do. Class and id of the start
    tags numbered in ``lifted`` bar nothing.
    """
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, tuple[int, ...]]] = []  # name, hard, region, named
    number = 0
    parts: list[str] = []
    linked, heading = 0, False
    in_link = 0  # open elements where the open link began, and one more; 0 outside links

    def flush() -> None:
        nonlocal parts, linked, heading
        text = " ".join("".join(parts).split())
        if text:
            _, hard, region, named_by = stack[-1] if stack else ("", False, False, ())
            out.append(Block(text, linked, heading, region, hard or bool(named_by), named=named_by, hard=hard))
        parts, linked, heading = [], 0, False

    def pop_to(name: str) -> None:
        while stack:
            if stack.pop()[0] == name:
                break

    for kind, value, attrs in tokens(html):
        if kind == TEXT:
            if stack and stack[-1][0] in NEVER:
                continue
            parts.append(value)
            if in_link > len(stack) + 1:  # an element that held the link has ended, and the link with it
                in_link = 0
            if in_link:
                linked += len("".join(value.split()))
        elif kind == START:
            if value == "br":
                parts.append(" ")
                continue
            if value == "a":  # without an address it is a mark, not a link
                in_link = len(stack) + 1 if "href" in attrs else 0
            boundary = value in BLOCKS
            if boundary or value in NEVER:
                flush()
            for closed in CLOSES.get(value, ()):
                _close_sibling(stack, closed, value)
            if value == "p" or value in HEADINGS:
                if stack and stack[-1][0] in ("p", *HEADINGS):
                    stack.pop()
            _, hard, region, named_by = stack[-1] if stack else ("", False, False, ())
            barred = hard or bool(named_by)
            if value in VOID:
                continue
            number += 1

            def bars(inside: bool) -> bool:
                return number not in lifted and hinted(attrs, inside)

            if not boundary and value not in NEVER and not (hints and not barred and attrs and (hidden(attrs) or bars(region))):
                continue  # inline, says nothing of the place
            if not boundary and value not in NEVER:
                flush()
            inner_region = region or value in REGIONS and not barred
            never = value in NEVER or value == "header" and not region
            outer = not hints or value in ("html", "body")
            own = (number,) if not outer and bars(inner_region) else ()
            stack.append((value, hard or never or not outer and hidden(attrs), inner_region, named_by + own))
            if value in HEADINGS:
                heading = True
        elif kind == END:
            if value == "a":
                in_link = 0
                continue
            known = any(s[0] == value for s in stack)
            if value in BLOCKS or known:
                flush()
            if known:
                pop_to(value)
    flush()
    return out


def _close_sibling(stack: list, closed: str, opener: str) -> None:
    """End an open element that a new sibling implies the end of, but not one of an outer list."""
    fence = {"li": ("ul", "ol", "menu"), "option": ("select",)}.get(opener, ("table", "dl"))
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] in fence:
            return
        if stack[i][0] == closed:
            del stack[i:]
            return


@lru_cache(maxsize=1024)  # the blocks of a page are asked for more than once
def stop_density(text: str) -> float:
    words = _WORDS.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def is_linked(b: Block) -> bool:
    return b.linked > LINKED * max(1, len(b.text.replace(" ", "")))


def knows(page: list[Block]) -> bool:
    """Whether the stop words tell anything of a page: some block that could be prose has enough. In
    a language that they don't know, length and link density decide alone."""
    return any(stop_density(b.text) >= FEW_STOPS for b in page if len(b.text) > LONG and not is_linked(b)) or not any(len(b.text) > LONG and not is_linked(b) for b in page)


def is_prose(b: Block, known: bool = True) -> bool:
    """Whether the rules on length, links and stop words take a block for running text."""
    return len(b.text) > LONG and not is_linked(b) and (not known or stop_density(b.text) >= FEW_STOPS)


def by_rules(b: Block, known: bool = True) -> str:
    """A block's label by its own text."""
    n = len(b.text)
    if is_linked(b) or "©" in b.text and n < LONG:
        return BAD
    if n < SHORT:
        return BAD if b.linked else SHORT_BLOCK
    if not known:
        return GOOD if n > LONG else MIDDLING
    stops = stop_density(b.text)
    prose = stops >= MANY_STOPS or stops >= FEW_STOPS and n > LONG
    return GOOD if prose and n > LONG else BAD if b.linked and stops < FEW_STOPS else MIDDLING


def first_pass(page: list[Block]) -> None:
    """Label each block on its own: good, bad, short or middling.

    Articles and main parts are evidence if they hold at least as much prose as the rest: what
    the rules leave open is then good inside and bad outside, links inside are left to the
    neighbours, and inside a bad label needs a text whose language the stop words know. What
    the rules find good stays good outside as well. Elsewhere the rules alone decide.
    """
    free = [b for b in page if not b.barred]
    known = knows(free)
    weight = [sum(len(b.text) for b in free if b.region == inside and is_prose(b, known)) for inside in (False, True)]
    trusted = any(b.region for b in free) and weight[1] >= weight[0]
    for b in page:
        b.label = BAD if b.barred else by_rules(b, known)
        if not trusted or b.barred:
            continue
        if not b.region:
            b.label = GOOD if b.label == GOOD else BAD
        elif is_linked(b):
            b.label = SHORT_BLOCK
        elif b.label != BAD or len(b.text) < SHORT and "©" not in b.text or not weight[1]:
            b.label = GOOD
    run = []
    for b in [*page, None]:  # link-only rows make a menu
        if b is not None and b.label != BAD and b.linked and b.linked >= 0.9 * len(b.text.replace(" ", "")) and len(b.text) < SHORT:
            run.append(b)
            continue
        if len(run) >= MENU_ROWS:
            for x in run:
                x.label = BAD
        run = []


def second_pass(page: list[Block]) -> None:
    """Give ambiguous blocks the label of their nearest decided neighbours.

    Blocks that the markup bars say nothing of what stands beside them and are no neighbours.
    Both neighbours alike, or the only one, decide. Between a good and a bad one, a middling
    block (which reads like prose) is good, and a short one is as well if it is a heading
    shortly before good text, else bad. If nothing is decided, all that isn't barred is good.
    """
    n = len(page)
    left: list[str | None] = [None] * n
    right: list[str | None] = [None] * n
    last = None
    for i, b in enumerate(page):
        left[i] = last
        last = b.label if b.label in (GOOD, BAD) and not b.barred else last
    last = None
    for i in range(n - 1, -1, -1):
        b, right[i] = page[i], last
        last = b.label if b.label in (GOOD, BAD) and not b.barred else last
    found = []
    for i, b in enumerate(page):
        around = {left[i], right[i]} - {None}
        if b.label in (GOOD, BAD):
            found.append(b.label)
        elif len(around) < 2:
            found.append(around.pop() if around else GOOD)
        elif b.label == MIDDLING:
            found.append(GOOD)
        elif b.heading and right[i] == GOOD:
            gap = 0
            for later in page[i + 1 :]:
                if later.label == GOOD or gap > NEAR_HEADING:
                    break
                gap += len(later.text)
            found.append(GOOD if gap <= NEAR_HEADING else BAD)
        else:
            found.append(BAD)
    for b, label in zip(page, found, strict=True):
        b.label = label


def misnamed(page: list[Block]) -> frozenset[int]:
    """Numbers of start tags whose class or id bars the page's main text: they hold over half of
    its prose, and what no class or id bars holds less than half of what they do."""
    prose = {id(b): len(b.text) for b in page if b.named and not b.hard and is_prose(b)}
    free = sum(len(b.text) for b in page if not b.barred and is_prose(b))
    lost: dict[int, int] = {}
    for b in page:
        for k in b.named if id(b) in prose else ():
            lost[k] = lost.get(k, 0) + prose[id(b)]
    whole = free + sum(prose.values())
    return frozenset(k for k, n in lost.items() if 2 * n > whole and 2 * free < n)


def main_text(html: str | None) -> str:
    """The main text of one page: its good blocks in order, joined by one space."""
    if not html:
        return ""
    page = blocks(html)
    if any(b.named for b in page) and (lifted := misnamed(page)):
        page = blocks(html, lifted=lifted)
    if all(b.barred for b in page):  # a name that bars the whole page says nothing; its prose does
        page = blocks(html, hints=False)
        for b in page:
            b.barred = b.barred or len(b.text) < LONG or stop_density(b.text) < FEW_STOPS
    first_pass(page)
    second_pass(page)
    return " ".join([b.text for b in page if b.label == GOOD])


def extract(df: DataFrame, html_col: str = "html", out: str = "text", length: str = "n_chars") -> DataFrame:
    """``df``'s rows with their page's main text and its number of code points.

    The whole page counts. Null and empty pages, and those without main text, give the empty
    string and 0. Repeated rows stay, an empty table gives an empty one; columns of ``df`` that
    have one of the new names give way to them. A map without shuffle.
    """

    @F.pandas_udf("string")
    def text_of(pages):
        import pandas as pd

        return pd.Series([main_text(p) for p in pages], dtype="object")

    return df.withColumn(out, text_of(named(html_col).cast("string"))).withColumn(length, F.length(named(out)).cast("long"))
