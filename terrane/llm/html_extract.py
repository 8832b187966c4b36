"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: elements (a tag with its class and id, told apart by the elements
around it, its path), blocks of text (told apart by their words and their element), and each word of a
short block with its neighbours. Over the distinct pages of a host, tokens with equal occurrence vectors form
equivalence classes. A class that is large enough and that enough of the host's pages have is valid if its tokens
come in one order on all pages, it crosses no other class, and it has one place among the others; else it is cut
into parts for which that holds, or goes. Tokens outside of classes are then told apart by the gap of a class that they stand
in, and the roles found so form classes again, until no more are told apart. The tokens of valid classes are the
host's template, in these roles only. What lies between them are slots. Blocks that belong to the template go, whatever their tags and names, and so do
runs of template words in blocks that differ between pages. Slots under menus, notices and the like are
labelled by the elements around them; of the other elements, the one that holds most text in slots is the
article, and a page's text is what its slots hold, whole.

What stands inside an element that its tag or role marks as the article is no template for being on several
pages: copies of an article are the same article. There only a block goes that is template text elsewhere, outside
of articles.

Occurrence vectors are compared as the XOR of one hash per page and count, over pages that differ
in their html, so they are summed up before the shuffle and a host of any size is never in one
task. A host's template has no more tokens than a few pages. Templates are broadcast while they are
few (`broadcast_tokens`), else pages meet them in a join that splits large hosts.

Defined cases: null, empty or blank html gives ''; a null url belongs to the host ''; a host with
fewer than `min_text_pages` distinct pages has no template text; a page with nothing but template
text gives ''; pages that lack the host's article element use the rank order of elements, then
their own; broken or cut-off markup is read to its end; repeated rows get one result each; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|object|canvas|math|title|textarea|select|button|audio|video|map)(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*+>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)\s*+(?:=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output q ruby rp rt s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements, roles and names that label what isn't the article.
_ASIDE_TAGS = frozenset("head nav footer aside form menu dialog fieldset".split())
_ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
_ASIDE_NAMES = frozenset(
    "ad adbox ads adv advert adverts advertisement advertising adsense alert alerts banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promotion recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar masthead widget widgets".split()
)
#: Words that may stand beside these in one class value. A value with any other word (no-sidebar, has-comments) says nothing.
_BESIDE = frozenset("site page main left right top bottom upper lower primary secondary global mobile desktop box bar area container wrapper wrap inner outer list section block item items link links row panel group slot unit body form button buttons icons count post article entry head title text".split())
_HEADER_NAMES = frozenset("header site-header page-header top-header masthead siteheader pageheader".split())
_HOLDERS = frozenset("body div section article main td table center blockquote ul ol dl".split())
_ARTICLE_NAMES = frozenset("article content main post entry story maincontent articlebody postcontent entrycontent articlecontent postbody storybody".split())
_HEAD = frozenset("head title base link meta style script noscript template".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ROOT = 0
#: Tokens of classes: number of the class, place in it, length of it. Levels: those of each round but the last.
Places = dict[int, tuple[int, int, int]]
Levels = Sequence[Places]


@dataclass(frozen=True)
class Roles:
    """A host's template text by role, and the classes that tell roles apart."""

    texts: frozenset[int] | set[int]
    levels: Levels


@dataclass(frozen=True)
class Deduction:
    #: A class is valid if it has so many tokens (text counts by its words) and so large a share of the host's pages.
    min_tokens: int = 3
    min_pages: float = 0.3
    #: Text that fewer distinct pages share is no template.
    min_text_pages: int = 3
    broadcast_tokens: int = 500_000


@dataclass
class Element:
    tag: str
    key: int
    aside: bool
    article: int  # 2: <article> or <main>, 1: named like one, 0
    parent: Element | None
    count: int = 0
    mass: int = 0
    place: int = 0
    text: int = 0
    inside: bool | None = None
    #: Whether it stands in an element that tag or role marks as the article, or is one.
    within: bool = False


def _key(path: int, name: str) -> int:
    return int.from_bytes(blake2b(f"{path}/{name}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _names(value: str) -> list[str]:
    return [x for x in re.split(r"[\s_\-]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower()) if x]


def _names_aside(value: str) -> bool:
    """Whether one of the class values, read as a whole, names what isn't the article."""
    for one in value.split():
        names = _names(one)
        if not _ASIDE_NAMES.isdisjoint(names) and all(n in _ASIDE_NAMES or n in _BESIDE for n in names):
            return True
    return value.strip().lower() in _HEADER_NAMES


def _text_key(e: Element, block: str) -> int:
    return _key(e.key, f"#{block}")


#: Blocks of up to so many words have their words as tokens.
SHORT = 64


def _threes(e: Element, words: list[str]) -> list[int]:
    """A key for each three words in a row; the block's ends count as words."""
    padded = ["^", *words, "$"]
    return [_key(e.key, "#3 " + " ".join(padded[k : k + 3])) for k in range(len(words))]


def block_tokens(e: Element, block: str) -> dict[int, int]:
    """A block's tokens with their size in words: itself in its element, itself wherever it stands, and its words; none inside an article."""
    if e.aside or e.within:
        return {}
    words = block.split(" ")
    return {**(dict.fromkeys(_threes(e, words), 1) if len(words) <= SHORT else {}), _text_key(e, block): len(words), _key(ROOT, f"#{block}"): len(words)}


def slot(e: Element, block: str, template: frozenset[int] | set[int], least: int = 3) -> str:
    """What of a block isn't template: inside an article all, unless the block is template text outside of one. Runs of fewer than `least` template words stay."""
    if e.within:
        return "" if _key(ROOT, f"#{block}") in template else block
    if _text_key(e, block) in template:
        return ""
    words = block.split(" ")
    if len(words) > SHORT:
        return block
    covered = [False] * (len(words) + 2)
    for k, key in enumerate(_threes(e, words)):
        if key in template:
            covered[k : k + 3] = [True] * 3
    covered, out, run = covered[1:-1], [], []
    for word, gone in (*zip(words, covered, strict=True), ("", False)):
        if gone:
            run.append(word)
            continue
        if len(run) < least:
            out += run
        run = []
        out.append(word)
    return " ".join(out[:-1])


def _open(tag: str, attributes: str, parent: Element | None, inside_article: bool) -> Element:
    aside, named, article, name = tag in _ASIDE_TAGS, False, 2 if tag in ("article", "main") else 0, tag
    if attributes and len(attributes) > 4:
        for m in _ATTRIBUTE.finditer(attributes):
            a, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if a == "hidden" or a == "aria-hidden" and value == "true" or a == "style" and re.search(r"display\s*:\s*none", value, re.I):
                aside = True
            elif a == "role":
                aside |= value.lower() in _ASIDE_ROLES
                article = max(article, 2 * (value.lower() in ("main", "article")))
                name += f"@{value.lower()}"
            elif a in ("class", "id"):
                names = _names(value)
                named |= tag not in ("html", "body") and _names_aside(value)
                if not _ARTICLE_NAMES.isdisjoint(names) or "".join(names) in _ARTICLE_NAMES:
                    article = max(article, 1)
                name += f".{re.sub(r'[0-9]+', '0', value.strip())}"
    aside |= named and article < 2
    if tag == "header" and not inside_article:
        aside = True
    if parent is not None:
        aside |= parent.aside
    if aside:
        article = 0
    return Element(tag, _key(parent.key if parent else ROOT, name), aside, article, parent, within=article == 2 or parent is not None and parent.within)


def _read(html: str) -> tuple[list[Element], list[tuple[Element, str, int]]]:
    """The root and the elements in page order; each block of text with its element and the number of elements before it."""
    blocks: list[tuple[Element, str, int]] = []
    root = Element("#root", ROOT, False, 0, None)
    stack, at, text = [root], 0, []
    made, standing, articles = [root], Counter(), 0  # elements in page order; open ones by tag; open articles
    hidden: tuple[str, int, int] | None = None  # an inline element that isn't the article's: tag, its depth among equals, size of the stack

    def flush() -> None:
        if text:
            block = " ".join(unescape("".join(text)).split())
            text.clear()
            if block:
                blocks.append((stack[-1], block, len(made)))

    def pop() -> Element:
        nonlocal articles, hidden
        e = stack.pop()
        standing[e.tag] -= 1
        articles -= e.article == 2
        if hidden and len(stack) < hidden[2]:
            hidden = None  # its end tag is missing
        return e

    for m in _TOKEN.finditer(html):
        if m.start() > at and not hidden:
            text.append(html[at : m.start()])
        at = m.end()
        tag = m[3] or m[6]
        if not tag:
            if m[1] and m[1].lower() not in ("button", "map", "svg", "canvas", "math", "audio", "video"):
                flush()
            continue
        tag, closing = tag.lower(), m[2] or m[5]
        if tag in _INLINE:
            if hidden and tag == hidden[0]:
                hidden = (tag, hidden[1] + (-1 if closing else 1), hidden[2])
                if not hidden[1]:
                    hidden = None
            elif not hidden and not closing and tag not in _VOID and len(m[4] or m[7] or "") > 4 and _open(tag, m[4] or m[7], None, True).aside:
                hidden = (tag, 1, len(stack))
            continue
        flush()
        if tag in _VOID:
            continue
        if closing:
            if standing[tag] > 0:
                while pop().tag != tag:
                    pass
            continue
        if tag not in _HEAD and standing["head"] > 0:
            while pop().tag != "head":  # its end tag may be missing
                pass
        if tag == "p" and stack[-1].tag == "p":
            pop()
        for other in _CLOSES.get(tag, ()):
            if stack[-1].tag == other:
                pop()
        e = _open(tag, m[4] or m[7] or "", stack[-1], articles > 0)
        stack.append(e)
        made.append(e)
        standing[tag] += 1
        articles += e.article == 2
    if at < len(html) and not hidden:
        text.append(html[at:])
    flush()
    return made, blocks


def sequence(made: list[Element], read: list[tuple[Element, str, int]]) -> Iterator[tuple[int, int, int]]:
    """The page's tokens in order: key, size in words (0: an element), number of the block."""
    at = 1
    for number, (e, block, before) in enumerate(read):
        for x in made[at:before]:
            yield x.key, 0, -1
        at = before
        for key, words in block_tokens(e, block).items():
            yield key, words, number
    for x in made[at:]:
        yield x.key, 0, -1


def _slots(made: list[Element], read: list[tuple[Element, str, int]], template: frozenset[int] | set[int], told: Roles) -> list[tuple[Element, str]]:
    """What of each block isn't template in the role that its tokens have there."""
    here: dict[int, set[int]] = {}
    tokens = list(sequence(made, read))
    for (key, _, number), role in zip(tokens, roles([t[0] for t in tokens], told.levels), strict=True):
        if number >= 0 and role in told.texts:
            here.setdefault(number, set()).add(key)
    cut = ((e, slot(e, block, template if e.within else here[number]) if e.within or number in here else block) for number, (e, block, _) in enumerate(read))
    return [(e, block) for e, block in cut if block]


def parse(html: str, template: frozenset[int] | set[int] = frozenset(), told: Roles | None = None) -> tuple[list[tuple[Element, str]], dict[int, Element]]:
    """Blocks of text in slots with the element each stands in, and one element per token with its count, first place and text in all."""
    made, read = _read(html)
    blocks = _slots(made, read, template, told or Roles(template, ())) if template else [(e, block) for e, block, _ in read]
    tokens: dict[int, Element] = {}
    for place, e in enumerate(made[1:]):
        first = tokens.setdefault(e.key, e)
        if first is e:
            e.place = place
        first.count += 1
    for element, block in blocks:
        if not element.aside:
            element.text += len(block)
    for e in reversed(made):  # from the innermost outwards, so that depth costs nothing
        if e.parent is not None:
            e.parent.text += e.text
            tokens[e.key].mass += e.text
    return blocks, tokens


def _places(classes: Iterable[Sequence[int]]) -> Places:
    return {t: (c, k, len(tokens)) for c, tokens in enumerate(classes) for k, t in enumerate(tokens)}


def contexts(keys: Iterable[int], places: Places) -> list[int]:
    """Where each token stands: the member before it in the innermost class that is open there. ROOT for members and outside of classes."""
    out, stack = [], []
    for key in keys:
        place = places.get(key)
        if place is None:
            out.append(stack[-1][1] if stack else ROOT)
            continue
        out.append(ROOT)
        while place[1] and stack and stack[-1][0] != place[0]:
            stack.pop()
        if place[1] and stack:
            stack.pop()
        if place[1] < place[2] - 1:
            stack.append((place[0], key))
    return out


def _roles(keys: list[int], places: Places) -> list[int]:
    return [_key(where, f"@{key}") if where else key for key, where in zip(keys, contexts(keys, places), strict=True)]


def roles(keys: list[int], levels: Levels) -> list[int]:
    """The tokens told apart by where they stand among the classes of each round. Members of classes keep their role."""
    for places in levels:
        keys = _roles(keys, places)
    return keys


def disorder(keys: Iterable[int], places: Places) -> set[tuple[int, int]]:
    """Cuts (class, place) after which each part of a class comes in its order, whole and again and again, on this page.

    A step from a member to another than the next cuts behind the one and before the other."""
    last: dict[int, tuple[int, int]] = {}
    cuts = set()

    def step(c: int, a: int, b: int, n: int) -> None:
        if b != (a + 1) % n:
            cuts.update((c, k) for k in (a + 1, b) if 0 < k < n)

    for key in keys:
        place = places.get(key)
        if place is not None:
            c, k, n = place
            step(c, last[c][0] if c in last else n - 1, k, n)
            last[c] = (k, n)
    for c, (k, n) in last.items():
        step(c, k, 0, n)
    return cuts


def crossings(keys: Iterable[int], places: Places) -> set[tuple[int, int]]:
    """Cuts (class, place) after which a class stands in one gap of another or outside of it, on this page. Of two that cross, the later in the list is cut."""
    stack: list[tuple[int, int]] = []
    cuts = set()
    for key in keys:
        place = places.get(key)
        if place is None:
            continue
        c, k, n = place
        at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == c), None)
        if at is not None:
            if any(other < c for other, _ in stack[at + 1 :]):
                cuts.add((c, k))
                del stack[at]
            else:
                cuts.update((other, j + 1) for other, j in stack[at + 1 :])
                del stack[at:]
        if k < n - 1:
            stack.append((c, k))
    return cuts


def stands(keys: Iterable[int], places: Places) -> set[tuple[int, int]]:
    """Per class the gaps where it begins on this page: (class, member before it in the innermost open class that is earlier in the list)."""
    stack: list[tuple[int, int]] = []
    found = set()
    for key in keys:
        place = places.get(key)
        if place is None:
            continue
        c, k, n = place
        if k:
            while stack and stack.pop()[0] != c:
                pass
        else:
            found.add((c, next((member for other, member in reversed(stack) if other < c), ROOT)))
        if k < n - 1:
            stack.append((c, key))
    return found


def _parts(classes: list[list[int]], cuts: Iterable[tuple[int, int]]) -> list[list[list[int]]]:
    """Each class in the parts that the cuts leave."""
    ends: dict[int, set[int]] = {}
    for c, k in cuts:
        ends.setdefault(c, set()).add(k)
    out = []
    for c, tokens in enumerate(classes):
        at = [0, *sorted(ends.get(c, ())), len(tokens)]
        out.append([tokens[i:j] for i, j in zip(at, at[1:], strict=False)])
    return out


def grouped(members: list[dict]) -> list[list[int]]:
    """Tokens without class by equal vectors, in the order that one of their pages has. Those that stand in a gap of a class with their vector follow the member before that gap."""
    vector = lambda m: (m["vector"], m["pages"], m["n"])
    valid = {m["token"]: vector(m) for m in members if m["cls"] is not None}
    groups: dict[tuple, list[int]] = {}
    for m in sorted((m for m in members if m["cls"] is None), key=lambda m: (m["pos"], m["token"])):
        head = m["ctx"] if valid.get(m["ctx"]) == vector(m) else ROOT
        groups.setdefault((*vector(m), head), [head] if head else []).append(m["token"])
    return [groups[g] for g in sorted(groups)]


def _large(classes: Iterable[list[int]], size: dict[int, int], deduction: Deduction) -> list[list[int]]:
    return [c for c in classes if sum(size[t] for t in c) >= deduction.min_tokens]


def ordered(members: list[dict], groups: list[list[int]], cuts: Iterable[tuple[int, int]], deduction: Deduction) -> list[list[int]]:
    """The classes that were valid, with the tokens that found their place in a gap, then the new ones, on many pages first."""
    known = {m["token"]: m for m in members}
    size = {t: m["size"] for t, m in known.items()}
    old: dict[int, list[int]] = {}
    for m in sorted((m for m in members if m["cls"] is not None), key=lambda m: (m["cls"], m["place"])):
        old.setdefault(m["cls"], []).append(m["token"])
    fresh = []
    for first, *rest in _parts(groups, cuts):
        head = known[first[0]]
        if head["cls"] is None:
            fresh.append(first)
        else:
            tokens = old[head["cls"]]
            k = tokens.index(first[0]) + 1
            tokens[k:k] = first[1:]
        fresh += rest
    fresh = sorted(_large(fresh, size, deduction), key=lambda c: (-known[c[0]]["pages"], -sum(size[t] for t in c), c[0]))
    return [*old.values(), *fresh]


def nested(members: list[dict], classes: list[list[int]], cuts: Iterable[tuple[int, int]], deduction: Deduction) -> list[list[int]]:
    return _large((part for parts in _parts(classes, cuts) for part in parts), {m["token"]: m["size"] for m in members}, deduction)


def fixed(members: list[dict], classes: list[list[int]], gaps: Iterable[tuple[int, int]], deduction: Deduction) -> list[list[int]]:
    """The classes that always stand in the same gap of another, or always outside. Tokens of the others are told apart by the gap."""
    where: dict[int, set[int]] = {}
    for c, member in gaps:
        where.setdefault(c, set()).add(member)
    return [tokens for c, tokens in enumerate(classes) if len(where[c]) == 1]


def _rank(e: Element) -> int:
    """What speaks for an element as the article, before its text: 2 by tag or role, 1 by name; 0 a holder; -1 none."""
    if e.aside:
        return -1
    return e.article if e.article else 0 if e.tag in _HOLDERS else -1


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page its tokens: how often each is there, its first place, its size, and whether it is text. Text of menus and the like is never emitted, so it is left out."""
    for b in batches:
        keys, counts, sizes, texts, firsts, ends = [], [], [], [], [], [0]
        for html in b.column("html"):
            said: dict[int, list[int]] = {}
            for at, (key, words, _) in enumerate(sequence(*_read(html.as_py() or ""))):
                said.setdefault(key, [0, words, at])[0] += 1
            keys += [ROOT, *said]
            counts += [1, *(n for n, _, _ in said.values())]
            sizes += [1, *(w or 1 for _, w, _ in said.values())]
            texts += [False, *(w > 0 for _, w, _ in said.values())]
            firsts += [0, *(at for _, _, at in said.values())]
            ends.append(len(keys))
        fields = [pa.array(keys, pa.int64()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(texts, pa.bool_()), pa.array(firsts, pa.int64())]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, names=["token", "n", "size", "is_text", "first"]))
        yield pa.RecordBatch.from_arrays([b.column("host"), b.column("page"), lists], names=["host", "page", "tokens"])


_MEMBERS = "array<struct<token: long, vector: long, pages: long, n: long, pos: long, size: long, is_text: boolean, base: long, ctx: long, cls: int, place: int>>"
_STATE = f"host string, members {_MEMBERS}, classes array<array<long>>"
_ROLES = "array<struct<token: long, was: long, size: long, is_text: boolean, base: long, ctx: long, cls: int, place: int>>"


def _by_token(each: DataFrame) -> DataFrame:
    """Per host and token its occurrence vector. each: host, page, token, n, first and what the token is, one row per distinct page."""
    same = [F.max(c).alias(c) for c in ("size", "is_text", "base", "ctx", "cls", "place", "was")]
    return each.groupBy("host", "token").agg(
        F.bit_xor(F.xxhash64("page", "n")).alias("vector"), F.count(F.lit(1)).alias("pages"), F.sum("n").alias("n"), F.min_by("first", "page").cast("long").alias("pos"), *same
    )


def _frequent(by_token: DataFrame, hosts: DataFrame, deduction: Deduction) -> DataFrame:
    """Per host the tokens that enough of its pages have. hosts: host, all."""
    often = by_token.where((F.col("token") != ROOT) & (~F.col("is_text") | (F.col("pages") >= deduction.min_text_pages))).join(hosts, "host").where(F.col("pages") >= deduction.min_pages * F.col("all"))
    fields = ("token", "vector", "pages", "n", "pos", "size", "is_text", "base", "ctx", "cls", "place")
    return often.groupBy("host").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("members"))


def _settled(what: Callable, deduction: Deduction) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of hosts with their classes settled by grouped, ordered, nested or fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.to_pylist():
                if what is grouped:
                    out.append(grouped(row["members"]))
                else:
                    out.append(what(row["members"], row["classes"], [(c["cls"], c["at"]) for c in row["cuts"] or ()], deduction))
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("members"), pa.array(out, pa.list_(pa.list_(pa.int64())))], names=["host", "members", "classes"])

    return run


def _cuts(find: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The cuts that pages ask for, by disorder or crossings, or the gaps that stands finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[object, Places] = (None, {})
        for b in batches:
            rows: set[tuple] = set()
            for host, keys, classes in zip(b.column("host").to_pylist(), b.column("keys"), b.column("classes"), strict=True):
                if held[0] != host:
                    held = (host, _places(classes.as_py()))
                rows.update((host, *cut) for cut in find(keys.as_py(), held[1]))
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int64()), strict=True)], names=["host", "cls", "at"])

    return run


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page its frequent tokens, in order."""
    held: tuple[object, set[int]] = (None, set())
    for b in batches:
        out = []
        for host, html, often in zip(b.column("host").to_pylist(), b.column("html"), b.column("often"), strict=True):
            if held[0] != host:
                held = (host, set(often.as_py()))
            out.append([key for key, _, _ in sequence(*_read(html.as_py() or "")) if key in held[1]])
        yield pa.RecordBatch.from_arrays([b.column("host"), b.column("page"), pa.array(out, pa.list_(pa.int64()))], names=["host", "page", "keys"])


def _told_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page its frequent tokens by role, in order, with what each is."""
    held: tuple[object, dict[int, tuple], Places] = (None, {}, {})
    for b in batches:
        pages, hosts, out, ends = b.column("page"), b.column("host").to_pylist(), [], [0]
        for host, keys, members, classes in zip(hosts, b.column("keys"), b.column("members"), b.column("classes"), strict=True):
            if held[0] != host:
                held = (host, {m["token"]: (m["size"], m["is_text"], m["base"]) for m in members.as_py()}, _places(classes.as_py()))
            _, known, places = held
            mine = [k for k in keys.as_py() if k in known]
            for key, role, where in zip(mine, _roles(mine, places), contexts(mine, places), strict=True):
                out.append((role, key, *known[key], where, *places.get(key, (None, None))[:2]))
            ends.append(len(out))
        columns = list(zip(*out, strict=True)) or [()] * 8
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        fields = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["token", "was", "size", "is_text", "base", "ctx", "cls", "place"])
        yield pa.RecordBatch.from_arrays([b.column("host"), pages, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), fields)], names=["host", "page", "tokens"])


def _side(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df.hint("shuffle_hash")


def _classes(pages: DataFrame, frequent: DataFrame, deduction: Deduction, scratch: Scratch, few: bool) -> DataFrame:
    """host, members, classes: tokens of equal vectors, cut until they are ordered, then until they are nested; those without a fixed place go. pages: host, keys."""
    state = frequent.select("host", "members").mapInArrow(_settled(grouped, deduction), _STATE)
    for find, settle in ((disorder, ordered), (crossings, nested), (stands, fixed)):
        found = pages.join(_side(state.select("host", "classes"), few), "host").select("host", "keys", "classes").mapInArrow(_cuts(find), "host string, cls int, at long")
        cuts = found.groupBy("host").agg(F.collect_set(F.struct("cls", "at")).alias("cuts"))
        state = scratch.keep(state.join(cuts, "host", "left").select("host", "members", "classes", "cuts").mapInArrow(_settled(settle, deduction), _STATE))
    return state


def template_texts(pages: DataFrame, deduction: Deduction) -> DataFrame:
    """host, tokens: the text of the valid classes; told: its roles, and the classes of each round but the last, which tell roles apart. pages: host, page (a hash of html), html.

    In rounds: tokens of equal vectors are classes; these are cut where pages disagree with their order or where they
    cross others, and go if they have no fixed place among the others. Tokens outside of classes are told apart by the gap of a
    class that they stand in. Rounds end when that tells no more tokens apart."""
    scratch = Scratch(pages.sparkSession, "tokens")
    profile = pages.mapInArrow(_profiles, "host string, page long, tokens array<struct<token: long, n: long, size: long, is_text: boolean, first: long>>")
    each = profile.dropDuplicates(["host", "page"]).select("host", "page", F.inline("tokens"))
    nothing = {"ctx": F.lit(ROOT).cast("long"), "cls": F.lit(None).cast("int"), "place": F.lit(None).cast("int"), "was": F.col("token"), "base": F.col("token")}
    by_token = _by_token(each.withColumns(nothing))
    by_token = scratch.keep(by_token.where(~F.col("is_text") | (F.col("pages") >= deduction.min_text_pages)))
    hosts = by_token.where(F.col("token") == ROOT).select("host", F.col("pages").alias("all"))
    # a role is on no more pages than its token, so hosts without frequent text have no template text
    frequent = scratch.keep(_frequent(by_token, hosts, deduction).where(F.exists("members", lambda m: m.is_text)))
    total = frequent.agg(F.sum(F.size("members")).alias("n")).first()["n"] or 0
    few = total <= deduction.broadcast_tokens
    levels: list[DataFrame] = []
    if total:
        often = frequent.select("host", F.transform("members", lambda m: m.token).alias("often"))
        found = pages.join(_side(often, few), "host").select("host", "page", "html", "often").mapInArrow(_sequences, "host string, page long, keys array<long>")
        told = scratch.keep(found.dropDuplicates(["host", "page"]))
    state = frequent
    while total:
        state = _classes(told, frequent, deduction, scratch, few)
        levels.append(state.select("host", "classes"))
        apart = told.join(_side(state, few), "host").select("host", "page", "keys", "members", "classes").mapInArrow(_told_apart, f"host string, page long, tokens {_ROLES}")
        told = scratch.keep(apart)
        each = told.select("host", "page", F.posexplode("tokens").alias("at", "t")).select("host", "page", "at", "t.*")
        same = [F.max(c).alias(c) for c in ("size", "is_text", "base", "ctx", "cls", "place", "was")]
        by_token = scratch.keep(_by_token(each.groupBy("host", "page", "token").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), *same)))
        n = by_token.agg(F.count(F.lit(1)).alias("roles"), F.count_distinct("host", "was").alias("tokens")).first()
        if n.roles == n.tokens:
            break
        told = told.select("host", "page", F.col("tokens.token").alias("keys"))
        frequent = scratch.keep(_frequent(by_token, hosts, deduction))
    out = state.withColumn("levels", F.array().cast("array<array<array<long>>>"))
    if not total:
        return out.select("host", F.array().cast("array<long>").alias("tokens"), F.struct(F.array().cast("array<long>").alias("texts"), "levels").alias("told"))
    for level in levels[:-1]:
        earlier = level.withColumnRenamed("classes", "more")
        out = out.join(earlier, "host", "left").withColumn("levels", F.concat("levels", F.array(F.coalesce("more", F.array().cast("array<array<long>>"))))).drop("more")
    out = out.withColumn("valid", F.flatten("classes")).withColumn("texts", F.filter("members", lambda m: m.is_text & F.array_contains("valid", m.token)))
    out = out.select("host", F.array_sort(F.array_distinct("texts.base")).alias("tokens"), F.col("texts.token").alias("texts"), "levels")
    out = out.select("host", "tokens", F.struct("texts", "levels").alias("told"))
    return out.where(F.size("tokens") > 0)


def _told(row: dict | None) -> Roles | None:
    return Roles(set(row["texts"]), [_places(x) for x in row["levels"]]) if row else None


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page and element: place, text in slots, and rank."""
    held: tuple[object, set[int], Roles | None] = (None, set(), None)
    for b in batches:
        rows: list[tuple] = []
        for host, html, tokens, told in zip(b.column("host").to_pylist(), b.column("html"), b.column("tokens"), b.column("told"), strict=True):
            if held[0] != host:
                held = (host, set(tokens.as_py() or ()), _told(told.as_py()))
            _, own = parse(html.as_py() or "", held[1], held[2])
            rows.append((host, ROOT, 0, 0, -1))
            rows += [(host, k, e.place, e.mass, _rank(e)) for k, e in own.items()]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["host", "token", "place", "mass", "rank"])


def ranking(pages: DataFrame, deduction: Deduction) -> DataFrame:
    """host, ranked: the elements that may hold the article, best first. pages: host, html, tokens, told."""
    rows = pages.mapInArrow(_holders, "host string, token long, place long, mass long, rank int")
    by_token = rows.groupBy("host", "token").agg(F.count(F.lit(1)).alias("pages"), F.min("place").alias("place"), F.sum("mass").alias("mass"), F.max("rank").alias("rank"))
    by_token = Scratch(pages.sparkSession, "holders").keep(by_token)
    hosts = by_token.where(F.col("token") == ROOT).select("host", F.col("pages").alias("all"))
    often = by_token.where(F.col("token") != ROOT).join(hosts, "host").where(F.col("pages") >= deduction.min_pages * F.col("all"))
    flat = often.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("place", "token", "mass", "rank"))).alias("members"))
    holders = F.filter("members", lambda m: (m["rank"] >= 0) & (m.mass > 0))
    most = F.array_max(F.transform("members", lambda m: m.mass))
    # by tag or name: the outermost with text; else the innermost that holds most of it
    scored = F.transform(
        holders,
        lambda m: F.struct(
            F.when(m.mass * 5 >= most, -m["rank"]).otherwise(1).alias("a"),
            F.when(m["rank"] > 0, -m.mass.cast("double")).when(m.mass * 10 >= most * 8, -m.place.cast("double")).otherwise(1.0 / (1 + m.mass)).alias("b"),
            m.place.alias("c"),
            m.token.alias("token"),
        ),
    )
    return flat.select("host", F.transform(F.array_sort(scored), lambda s: s.token).alias("ranked"))


def extract_page(html: str | None, tokens: set[int], ranked: list[int], told: Roles | None = None) -> list[str]:
    """The slots of the page's article, in page order. tokens: the host's template text; told: in which role it is that, else in all."""
    if not html:
        return []
    blocks, own = parse(html, tokens, told)
    mine = [k for k in ranked if k in own and own[k].mass > 0]
    strong = [k for k in mine if own[k].article]
    better = [e.key for e in own.values() if e.article == 2 and e.mass > 0]
    main = strong[0] if strong else max(better, key=lambda k: own[k].mass) if better else mine[0] if mine else None
    if main is None:
        holders = [e for e in own.values() if _rank(e) >= 0 and e.mass > 0]
        main = max(holders, key=lambda e: (_rank(e), e.mass, e.place)).key if holders else ROOT
    out = []
    for element, block in blocks:
        if element.aside:
            continue
        way: list[Element] = []
        e: Element | None = element
        while e is not None and e.inside is None and e.key != main:
            way.append(e)
            e = e.parent
        inside = main == ROOT if e is None else e.key == main or bool(e.inside)
        for x in way:
            x.inside = inside
        if inside:
            out.append(block)
    return out


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: tuple[object, set[int], list[int], Roles | None] = (None, set(), [], None)
    for b in batches:
        texts = []
        for host, html, tokens, told, ranked in zip(b.column("host").to_pylist(), b.column("html"), b.column("tokens"), b.column("told"), b.column("ranked"), strict=True):
            if held[0] != host:
                held = (host, set(tokens.as_py() or ()), ranked.as_py() or [], _told(told.as_py()))
            texts.append(" ".join(extract_page(html.as_py(), *held[1:])))
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, deduction: Deduction = Deduction()) -> DataFrame:
    """Per row of pages: page_id, url, text, n_chars."""
    host = ascii_lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))
    known = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), F.xxhash64(F.coalesce("html", F.lit(""))).alias("page"), "html")
    scratch = Scratch(pages.sparkSession, "templates")

    def side(df: DataFrame, size) -> DataFrame:  # noqa: ANN001 - a column
        return _side(df, (df.agg(F.sum(size).alias("n")).first()["n"] or 0) <= deduction.broadcast_tokens)

    found = scratch.keep(template_texts(known.select("host", "page", "html"), deduction))
    tokens = F.size("tokens") + F.size("told.texts") + F.aggregate("told.levels", F.lit(0), lambda n, x: n + F.size(F.flatten(x)))
    met = known.select("page_id", "url", "host", "html").join(side(found, tokens), "host", "left")
    ranked = scratch.keep(ranking(met.select("host", "html", "tokens", "told"), deduction))
    both = met.join(side(ranked, F.size("ranked")), "host", "left")
    return both.select("page_id", "url", "host", "html", "tokens", "told", "ranked").mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
